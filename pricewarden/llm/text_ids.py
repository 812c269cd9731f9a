"""Ids of whole texts under a byte-level vocabulary, many texts at a time."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

from pricewarden.llm.bpe import Vocabulary, byte_symbols
from pricewarden.llm.numbering import id_bytes
from pricewarden.llm.pieces import LibraryMemo, special_strings

# Texts of these characters fall into the same pretokens whatever edition of Unicode a library knows.
LATIN = re.compile("[\\x00-\\u024f\\u2010-\\u203a\\u20ac]*")
# The pretoken pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextIds:
    """The ids the tokenizers library gives, by a faster encoder where both must agree.

    The file's vocabulary is handed to tiktoken, whose merges by rank are those of the file when ids rise with the merges (checked
    here). It encodes texts of Latin letters without special strings; all others go to the tokenizers library itself.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        self.library = LibraryMemo(path)
        self.library.tokenizer.encode_special_tokens = plain_specials
        self.specials = () if plain_specials else special_strings(self.library.tokenizer)
        vocabulary = Vocabulary(path)
        known = {i: b for i, b in vocabulary.bytes.items() if i not in vocabulary.special.values()}
        self.table, self.begin, self.sizes = id_bytes([vocabulary.bytes.get(i, b"") for i in range(max(vocabulary.bytes) + 1)])
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        merged = [vocabulary.merges[pair][1] for pair in vocabulary.merges]
        by_rank = merged == sorted(merged) and len(known) == len(set(known.values())) == len(merged) + len(byte_symbols())
        plain = model["pre_tokenizer"]["type"] == "ByteLevel" and not model["pre_tokenizer"]["add_prefix_space"] and model["normalizer"] is None
        self.fast = None
        if by_rank and plain and max(vocabulary.single) < min(merged, default=1):
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks={b: i for i, b in known.items()}, special_tokens={})

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one buffer, and how many each text has."""
        fast = [self.fast is not None and LATIN.fullmatch(t) is not None and not any(s in t for s in self.specials) for t in texts]
        rest = iter(self.library.encoded([t for t, own in zip(texts, fast, strict=True) if not own]))
        found = [self.fast.encode_to_numpy(t, disallowed_special=()) if own else np.array(next(rest).ids, np.uint32) for t, own in zip(texts, fast, strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.zeros(0, np.uint32), *found]), counts

