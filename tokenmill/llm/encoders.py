"""Ids of whole texts by public tokenizer files, and the bytes of their tokens."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable

import numpy as np

from tokenmill.functions.bytelevel import byte_symbols

# fixed values: what the library's byte-level splitter and model must be
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
MODEL = {
    "type": "BPE",
    "dropout": None,
    "unk_token": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": None,
    "byte_fallback": False,
    "ignore_merges": False,
}


class ByteLevelEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file,
    without added special tokens.

    ``special`` says whether the strings of special tokens inside texts are
    those tokens, which is the library's default, or plain text. Where the file
    has nothing but the byte-level splitter and merges in the order of their
    ids, the tiktoken library gives the same ids in a fraction of the time; any
    other file goes through the tokenizers library.
    """

    def __init__(self, data: str, special: bool) -> None:
        settings = json.loads(data)
        model = settings["model"]
        back = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        by_id = {i: bytes(map(back.__getitem__, t)) for t, i in model["vocab"].items() if set(t) <= back.keys()}
        added = {t["content"]: t["id"] for t in settings["added_tokens"]}
        by_id |= {i: t.encode() for t, i in added.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        made = [model["vocab"].get(a + b) for a, b in merges]
        plain = (
            settings["normalizer"] is None
            and settings["post_processor"] is None
            and BYTE_LEVEL.items() <= settings["pre_tokenizer"].items()
            and MODEL.items() <= model.items()
            and made == list(range(256, 256 + len(made)))
            and len(model["vocab"]) == 256 + len(made)
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in settings["added_tokens"])
        )
        self.encode = self._by_ranks(added, special) if plain else self._by_library(data, special)

    def _by_ranks(self, added: dict[str, int], special: bool) -> Callable[[str], np.ndarray]:
        import tiktoken

        ranks = {t: i for i, t in enumerate(self.tokens) if i not in added.values()}
        known = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        allowed = set(added) if special else set()
        return lambda text: known.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    def _by_library(self, data: str, special: bool) -> Callable[[str], np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        known = Tokenizer.from_str(data)
        known.encode_special_tokens = not special
        return lambda text: np.array(known.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class PieceEncoder:
    """Ids by the sentencepiece library. Its pieces are text with U+2581 for a
    blank, or one byte as <0xHH>."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.known = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = [self.bytes_of(self.known.id_to_piece(i)) for i in range(self.known.get_piece_size())]

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        one = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.known.encode(text), dtype=np.uint32)


_known: dict[tuple, object] = {}


def _once(make, data: str | bytes, *more):
    """One for each process and file."""
    key = (make, zlib.crc32(data if isinstance(data, bytes) else data.encode()), *more)
    if key not in _known:
        _known[key] = make(data, *more)
    return _known[key]


def byte_level_encoder(data: str, special: bool) -> ByteLevelEncoder:
    return _once(ByteLevelEncoder, data, special)


def piece_encoder(model: bytes) -> PieceEncoder:
    return _once(PieceEncoder, model)
