"""Public tokenizers over Arrow batches: texts are cut where no token can cross, each distinct piece is encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard

# White space as Unicode defines it, which is what the tokenizers' patterns mean by it.
WHITE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Byte-level vocabularies: a word with the blank before it is one or more whole pretokens, and so is a run of white space
# without that blank.
BYTE_LEVEL = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# Vocabularies that drop white space: any ASCII white space ends a pretoken.
WORD_LEVEL = re.compile(r"[^ \t-\r]+")
SLICE_BYTES = 4 << 20  # text handled at a time inside a batch
ENCODE_BYTES = 1 << 20  # text given to the library in one call
MEMO_PIECES = 400_000  # distinct pieces a worker remembers


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `rows` rows and about `limit` bytes of text; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + (n or 0) > limit or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


class Memo:
    """Results per distinct piece. Forgets everything once too many pieces are held, so memory stays bounded."""

    def __init__(self, limit: int = MEMO_PIECES):
        self.known: dict[str, object] = {}
        self.limit = limit

    def compute(self, pieces: list[str]) -> Iterable[object]:
        raise NotImplementedError

    def of(self, pieces: set[str]) -> dict[str, object]:
        missing = [p for p in pieces if p not in self.known]
        if missing and len(self.known) + len(missing) > self.limit:
            self.known, missing = {}, list(pieces)
        if missing:
            self.known.update(zip(missing, self.compute(missing), strict=True))
        return self.known


class LibraryMemo(Memo):
    """Pieces encoded by the tokenizers library, in calls balanced by bytes."""

    def __init__(self, path: str, limit: int = MEMO_PIECES):
        super().__init__(limit)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encoded(self, pieces: list[str]) -> Iterator[object]:
        call, size = [], 0
        for piece in pieces:
            if call and size + len(piece) > ENCODE_BYTES:
                yield from self.tokenizer.encode_batch_fast(call, add_special_tokens=False)
                call, size = [], 0
            call.append(piece)
            size += len(piece)
        if call:
            yield from self.tokenizer.encode_batch_fast(call, add_special_tokens=False)


def byte_level_pieces(text: str, specials: tuple[str, ...]) -> list[str]:
    """Pieces of a text for a byte-level vocabulary; special strings are cut out first, as the library does."""
    if any(s in text for s in specials):
        parts = re.split("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")", text)
        return [p for part in parts for p in ([part] if part in specials else BYTE_LEVEL.findall(part))]
    return BYTE_LEVEL.findall(text)


def special_strings(tokenizer) -> tuple[str, ...]:
    return tuple(token.content for token in tokenizer.get_added_tokens_decoder().values())


_WORKER: dict[tuple, object] = {}


def per_worker(key: tuple, make) -> object:
    """An object kept for all tasks of a Python worker, such as a loaded vocabulary; only the latest of a kind stays."""
    if key not in _WORKER:
        for other in [k for k in _WORKER if k[0] == key[0]]:
            del _WORKER[other]
        _WORKER[key] = make()
    return _WORKER[key]


def pack_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column `text` compressed as `packed`: texts that Python reads next take half the room in a shuffle."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        place = batch.schema.names.index("text")
        packed = pa.array([press(t.encode()) for t in batch.column(place).to_pylist()], pa.binary())
        names = ["packed" if n == "text" else n for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*batch.columns[:place], packed, *batch.columns[place + 1 :]], names)


def unpack(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts of a packed column."""
    open_up = zstandard.ZstdDecompressor().decompress
    return pa.array([open_up(p).decode() for p in column.to_pylist()], pa.string())
