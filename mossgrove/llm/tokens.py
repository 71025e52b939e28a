"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
import os
import re
from array import array

VOCABULARY = "byte_bpe_50k.json"
CACHED = 500_000
#: One pre-token each: letters of Latin blocks, which every version of Unicode calls letters.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: A space between other white space, or at the end after it: there a run of white space may be one token.
_RUN = re.compile(r"\s \s|\s \Z")


class _Words(dict):
    """Ids of `` word`` by word, as bytes. Bounded; a word that no longer fits is encoded each time."""

    def __init__(self, encoding):
        super().__init__()
        self.encode, self.piece = encoding.encode_ordinary, encoding._encode_single_piece
        self.ends = {x: array("I", self.encode(x)).tobytes() for x in ",."}

    def __missing__(self, word: str) -> bytes:
        if _LETTERS.fullmatch(word):
            ids = array("I", self.piece(" " + word)).tobytes()
        elif word[-1:] in self.ends and _LETTERS.fullmatch(word, 0, len(word) - 1):
            ids = self[word[:-1]] + self.ends[word[-1]]
        else:
            ids = array("I", self.encode(" " + word)).tobytes()
        if len(self) < CACHED and len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """Text to little-endian unsigned 32-bit ids, the ids that ``tokenizers`` gives for the vocabulary file.

    The file's pre-tokenizer never joins what a single space parts, so a text is encoded word by word with a
    cache; the same vocabulary's ranks encode words that aren't there. Texts in which that doesn't hold (runs of
    white space, strings of special tokens) go to ``tokenizers`` whole.
    """

    _loaded: dict = {}

    def __init__(self, path: str | None = None):
        import public_tokenizers

        path = path or public_tokenizers.path(VOCABULARY)
        if path not in self._loaded:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            ranks = os.path.splitext(path)[0] + ".tiktoken"
            words = None
            if os.path.exists(ranks):
                import tiktoken

                by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
                words = _Words(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={}))
            special = [x.content for x in whole.get_added_tokens_decoder().values()]
            self._loaded[path] = whole, words, special
        self.whole, self.words, self.special = self._loaded[path]

    def __call__(self, text: str) -> bytes:
        if self.words is None or _RUN.search(text) or any(x in text for x in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.words.encode(first)).tobytes() if first else b""
        return head + b"".join(map(self.words.__getitem__, rest))
