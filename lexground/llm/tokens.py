"""Encoding with the public vocabulary files, one white-space chunk at a time.

The word vocabulary drops white space before its merges and never merges across it, so a text's ids are the ids of its
chunks in order.  Chunks repeat, so their ids are kept in a bounded per-worker memo.  The tokenizer's pattern splits a chunk into pieces, and
the vocabulary's merges are run by a faster byte-pair merger; tests hold its ids against the tokenizer's.
"""

from __future__ import annotations

import os
import re
import struct

from .common import kept

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: A memo takes up to this many chunks, the first met being the frequent ones; longer chunks are encoded each time.
MEMO_CHUNKS, MEMO_CHARS = 120_000, 40


def vocabulary(name: str) -> str:
    """``name`` itself if it is a path, else the place of a file of ``public_tokenizers``."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters whose lower-casing and classes are the same here and in the tokenizer; any other chunk takes the tokenizer itself.
_SAFE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u00a1\u00ab\u00b7\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026\u20ac]*")
#: The tokenizer's own split pattern (a fixed value), for those characters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_WORD_END, _END_BYTE = "</w>", b"\xff"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(path: str):
    """The vocabulary as a byte-pair merger whose words end in a byte that no UTF-8 text holds."""
    import json

    import tiktoken

    alphabet, ranks = byte_alphabet(), {}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"]}
    for token, i in model["model"]["vocab"].items():
        if token not in special:
            ends = token.endswith(_WORD_END)
            ranks[bytes(alphabet[c] for c in token.removesuffix(_WORD_END)) + _END_BYTE * ends] = i
    ranks[_END_BYTE] = max(ranks.values()) + 1000  # never left over: any byte and the end merge first
    return tiktoken.Encoding("words", pat_str="", mergeable_ranks=ranks, special_tokens={})._core_bpe


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, name: str = WORD_VOCABULARY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.tokenizer, self.merger = Tokenizer.from_file(path), _merger(path)
        self.memo: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.merger.encode_single_piece(piece.encode() + _END_BYTE)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) < MEMO_CHUNKS:
            self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if _SAFE.fullmatch(chunk) and "<|" not in chunk:
            pieces = self.pieces
            return b"".join([pieces[p] if p in pieces else self._piece(p) for p in _SPLIT.findall(chunk.lower())])
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        memo, chunk_ids, out = self.memo, self._chunk, []
        for text in texts:
            ids = []
            for chunk in text.replace("\n", " ").split(" "):
                found = memo.get(chunk)
                if found is None:
                    found = chunk_ids(chunk)
                    if len(memo) < MEMO_CHUNKS and len(chunk) <= MEMO_CHARS:
                        memo[chunk] = found
                ids.append(found)
            out.append(b"".join(ids))
        return out


def word_encoder(name: str = WORD_VOCABULARY) -> WordEncoder:
    """One encoder per Python worker."""
    return kept(name, lambda: WordEncoder(name))


def slices(texts: list, most_chars: int = 4_000_000):
    """Runs of ``texts`` of bounded size, as (from, to)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
