"""Token ids of many texts by a public byte-level BPE tokenizer, with a bounded memory of chunks.

The tokenizer cuts a text before every space that follows something else, and nothing it does looks across such
a cut. A text is therefore encoded chunk by chunk, and a worker remembers the ids of the chunks it has
met: most of a corpus is words seen before.

The ids are those of the tokenizers library with its default settings, which read a special token's
string as that token. New chunks with such a string go to that library. All others go through a tiktoken
encoding built from the same file's vocabulary, which gives the same ids at a tenth of the cost:
a byte-level vocabulary without special tokens is a table of merge ranks.
"""

from __future__ import annotations

import os
import re

import numpy as np

from roadlens.llm.memory import Memory

_SPACED = re.compile(r" +[^ ]*|[^ ]+")
_LOADED: dict[str, "ChunkEncoder"] = {}


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in piece): i
                 for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if piece not in self.specials}
        plain = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.plain = plain._core_bpe.encode_ordinary if hasattr(plain, "_core_bpe") else plain.encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values()) + 1, "int64")
        self.bytes_of[list(ranks.values())] = list(map(len, ranks))
        self.memory = Memory()

    def _alone(self, chunk: str) -> list[int]:
        if any(s in chunk for s in self.specials):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return self.plain(chunk)

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number per chunk. Chunks that each start at a space are one text with cuts between them."""
        ids = np.array(self.plain("".join(chunks)), "uint32")
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), "int64", len(chunks)))
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "right")
        return ids, np.diff(upto, prepend=0)

    def _new(self, chunks: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks: those that start at a space as one text, the others one by one."""
        apart = np.fromiter((not (plain and c.startswith(" ")) for c in chunks), "bool", len(chunks))
        sizes = np.zeros(len(chunks), "int64")
        joined, sizes[~apart] = self._together([c for c, alone in zip(chunks, apart) if not alone])
        if not apart.any():
            return joined, sizes
        pieces = list(np.split(joined, np.cumsum(sizes[~apart])[:-1])) if len(joined) else []
        found, together = [], iter(pieces)
        for i, alone in enumerate(apart):
            found.append(np.array(self._alone(chunks[i]), "uint32") if alone else next(together))
            sizes[i] = len(found[-1])
        return np.concatenate(found), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each text."""
        self.memory.forget_if_full()
        spaced, whole = self.memory.known(" "), self.memory.known("")
        numbers = []
        for text in texts:
            if "  " in text:
                parts = _SPACED.findall(text)
                numbers.append(np.fromiter(map(whole.__getitem__, parts), "int64", len(parts)))
            elif text:
                rest = text.split(" ")
                first = rest.pop(0)
                found = np.fromiter(map(spaced.__getitem__, rest), "int64", len(rest))
                numbers.append(np.concatenate([[whole[first]], found]) if first else found)
            else:
                numbers.append(np.zeros(0, "int64"))
        plain = not any(s in text for s in self.specials for text in texts)
        self.memory.learn(lambda chunks: self._new(chunks, plain))
        return self.memory.gather(numbers)


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, special tokens included."""
    from tokenizers import Tokenizer
    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
