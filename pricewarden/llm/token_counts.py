"""Token counts: batches of distinct words encoded by the tokenizers library, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewarden.llm.common import texts
from pricewarden.llm.pieces import WORD_LEVEL, LibraryMemo, per_worker, sliced


class _Lengths(LibraryMemo):
    def compute(self, pieces):
        return [len(encoding) for encoding in self.encoded(pieces)]


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    memo = per_worker(("lengths", path), lambda: _Lengths(path))
    for batch in batches:
        for part in sliced(batch, "text"):
            words = [WORD_LEVEL.findall(text) for text in part.column("text").to_pylist()]
            lengths = memo.of({w for found in words for w in found})
            counts = [sum(map(lengths.__getitem__, found)) for found in words]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens) per input row, for a vocabulary whose tokens never span white space.

    Words between ASCII white space are safe pieces for such a vocabulary: no merge and no special string crosses them, so
    texts of any length are counted piece by piece and never cut elsewhere. Batches are cut into slices of equal bytes, and
    each distinct word of a slice goes to the library once; a worker remembers a bounded number of words. Special strings
    inside texts count as the library's default has it. No shuffle: one pass over the scan.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows: each gets its own row. Null doc_id: kept. Further columns are
    not read.
    """
    source = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return source.mapInArrow(lambda it: _counts(it, tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
