"""Token ids of whole texts by public vocabularies, word by word.

Both kinds of vocabulary end a token before a space that stands between two ASCII or Latin characters, so a text may be cut there,
and a piece that was seen before need not be tokenised again. Texts or vocabularies for which that does not hold are tokenised whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: A space at which a text may be cut: printable ASCII or a Latin letter stands on both sides.
CUT = re.compile(" (?<=[!-~À-ɏ] )(?=[!-~À-ɏ])")
#: What two tokenizers of one vocabulary surely take apart alike.
PLAIN = re.compile("[!-~À-ɏ][\n -~À-ɏ]*")
#: The word pattern of byte-level vocabularies (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def path(name: str) -> str:
    """Where the vocabulary of that name is on this machine; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary of `tokenizers`. Strings of special tokens are plain text."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        file = path(name)
        self.exact = Tokenizer.from_file(file)
        self.exact.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, alphabet = spec["model"], spec["pre_tokenizer"] or {}, byte_alphabet()
        vocabulary = model["vocab"]
        added = {x["content"] for x in spec["added_tokens"]}
        self.bytes = {i: bytes(map(alphabet.__getitem__, t)) if set(t) <= alphabet.keys() else t.encode() for t, i in vocabulary.items()}
        self.bytes |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        self.lengths[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
        self.fast = None
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if self.cuts and all(vocabulary[p] == 256 + k for k, p in enumerate(pairs)):  # ids are ranks
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in added}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def split(self, text: str) -> list[str]:
        """Pieces that, each after a space but for the first, make up the text."""
        return CUT.split(text) if self.cuts else [text]

    def encode(self, piece: str) -> bytes:
        """Its ids as little-endian unsigned 32-bit numbers."""
        return np.array(self.exact.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of these words after a space."""
        plain = [w for w in words if PLAIN.fullmatch(w)] if self.fast else []
        out = {w: self.encode(" " + w) for w in set(words).difference(plain)}
        if plain:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(plain)), "<u4")
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in plain), np.int64, len(plain)))
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            data, at = ids.tobytes(), 0
            for w, end in zip(plain, (4 * cuts).tolist()):
                out[w], at = data[at:end], end
        return out


class Memo(dict):
    """What `learn` says of words, for those asked for lately: two generations of about `most` characters each."""

    def __init__(self, learn: Callable[[list[str]], dict], most: int) -> None:
        super().__init__()
        self.learn, self.most, self.size, self.old = learn, most, 0, {}

    def need(self, words: set[str]) -> None:
        """From now on, until it is called again, these words are here."""
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        new = words.difference(self)
        again = {w: self.old[w] for w in new.intersection(self.old)}
        self.update(again)
        self.update(self.learn([*new.difference(again)]))
        self.size += sum(map(len, new))


def runs(texts: pa.Array, most: int) -> Iterator[list[str | None]]:
    """The texts in lists of about `most` characters; the last may be empty."""
    out, n = [], 0
    for text in texts:
        out.append(text.as_py())
        n += len(out[-1] or "")
        if n >= most:
            yield out
            out, n = [], 0
    yield out


class Pieces:
    """A vocabulary of `sentencepiece`, which puts a space before each text."""

    def __init__(self, name: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [self._bytes(i, p) for i, p in enumerate(pieces)]
        two = self.encode("a"), self.encode("b")
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces) and self.encode("a b") == two[0] + two[1]

    def _bytes(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: str | list[str]) -> list:
        return self.model.encode(texts, num_threads=1)
