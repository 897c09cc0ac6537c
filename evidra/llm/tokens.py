"""Token ids with a memory: equal chunks of text are encoded once per worker. Runs inside Python workers."""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array

MOST_CHUNKS, LONGEST_CHUNK = 200_000, 64  # of each of two generations
GAP = re.compile(r"(?= \S)")  # before a space that a word follows


class Memory(dict):
    """chunk -> ids. Two generations: when this one is full it becomes the old one, and what is met again moves up, so frequent chunks stay
    and memory is bounded. Chunks longer than ``LONGEST_CHUNK`` are not kept."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, chunk):
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk, self)
        if len(chunk) <= LONGEST_CHUNK:
            self[chunk] = ids
        return ids

    def make_room(self) -> None:
        if len(self) > MOST_CHUNKS:
            self.old = dict(self)
            self.clear()


class ChunkEncoder:
    """Text -> little-endian unsigned 32-bit ids. ``split`` cuts a text where no token can cross; ``make`` encodes a chunk."""

    def __init__(self, split, make):
        self.split, self.memory = split, Memory(make)

    def ids(self, text: str | None) -> bytes:
        self.memory.make_room()
        return b"".join(map(self.memory.__getitem__, self.split(text or "")))


def _packed(ids) -> bytes:
    return array("I", ids).tobytes()


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


def word_encoder(path: str) -> ChunkEncoder:
    """For a tokenizer file that drops white space and case: no token crosses an ASCII blank, nothing before or after one changes it, and
    A-Z may be lower-cased before.

    Runs of lower-case letters are one word to the tokenizer and go to its model directly, with a stop sign behind them as a word of its
    own; everything else takes the whole way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()

    def make(chunk: bytes, memory: Memory) -> bytes:
        if chunk.isalpha():
            return _packed([t.id for t in model.tokenize(chunk.decode())])
        if len(chunk) > 1 and chunk[-1] in b".,;:!?":
            body = chunk[:-1].decode()
            if body.isalpha():
                return memory[chunk[:-1]] + memory[chunk[-1:]]
        word = chunk.decode()
        if word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word):
            return _packed([t.id for t in model.tokenize("".join([letters[b] for b in chunk]))])
        return _packed(tokenizer.encode(word, add_special_tokens=False).ids)

    return ChunkEncoder(lambda text: text.encode().lower().split(), make)


def largest_id(path: str) -> int:
    """The largest id of a rank file."""
    with open(path, "rb") as lines:
        return max(int(line.split()[1]) for line in lines)


def byte_encoder(path: str, pattern: str) -> ChunkEncoder:
    """For a rank file of byte-level pairs: a space before a word starts a token, so texts are cut there. Special tokens in a text
    are ordinary text."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return ChunkEncoder(GAP.split, lambda chunk, _: _packed(encoding.encode_ordinary(chunk)))


def byte_decoder(path: str):
    """Ids -> bytes, for reading a packed matrix back."""
    with open(path, "rb") as lines:
        pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return lambda ids: b"".join(pieces[int(i)] for i in ids)
