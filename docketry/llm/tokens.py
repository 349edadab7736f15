"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

Where a vocabulary's normaliser and splitter never reach across ASCII white space, a text's ids are its
words' ids in order; a word's ids are kept in a bounded cache of the Python worker. tests/llm compare
this with encoding whole texts. Texts are encoded whole under any other vocabulary.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

_ENCODERS: dict[str, "Encoder"] = {}

#: Words that a Python worker keeps, the first ones; later ones are encoded each time. 100,000 take about 20 MB.
KEPT = 300_000


class Encoder(dict):
    """word bytes -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = KEPT):
        super().__init__()
        self.most = most
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        self.encode_one, self.by_word = made.encode, word_by_word(json.loads(made.to_str()))

    def __missing__(self, word: bytes) -> bytes:
        return self.learn([word])[0]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Encode new words in one call, a line each; a token belongs to the line that its offset falls in."""
        lines = [w.decode() for w in words]
        got = self.encode_one("\n".join(lines), add_special_tokens=False)
        ids, starts, out, at, end = got.ids, [o[0] for o in got.offsets], [], 0, 0
        for word, line in zip(words, lines, strict=True):
            end += len(line) + 1
            upto = bisect_left(starts, end, at)
            out.append(struct.pack(f"<{upto - at}I", *ids[at:upto]))
            at = upto
            if len(word) <= 64 and len(self) < self.most:
                self[word] = out[-1]
        return out

    def ids(self, text: str | None, end: int | None) -> bytes:
        """All ids of the text as bytes, and then the end id."""
        if not self.by_word:
            whole = self.encode_one((text or "").encode("utf-8", "replace").decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(whole)}I", *whole) + (b"" if end is None else struct.pack("<I", end))
        words = (text or "").encode("utf-8", "replace").split()
        new = {w: parts(w) for w in dict.fromkeys(words) if w not in self}
        if new:
            fresh = [p for p in dict.fromkeys(p for ps in new.values() for p in ps) if p not in self]
            made = dict(zip(fresh, self.learn(fresh), strict=True)) if fresh else {}
            for w, ps in new.items():
                new[w] = b"".join([made[p] if p in made else self[p] for p in ps])
                if len(w) <= 64 and len(self) < self.most:
                    self[w] = new[w]
            got = b"".join([new[w] if w in new else self[w] for w in words])
        else:
            got = b"".join(map(self.__getitem__, words))
        return got if end is None else got + struct.pack("<I", end)


# Fixed value: how the default vocabulary's splitter finds its pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_by_word(spec: dict) -> bool:
    """Whether words may be encoded apart, as far as is known: the normaliser composes, folds white space and lower-cases, the splitter
    takes pieces of PIECE and drops the rest, and all special tokens hold <|."""
    norm = (spec.get("normalizer") or {}).get("normalizers") or []
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = [n["type"] for n in norm] == ["NFC", "Replace", "Lowercase"] and norm[1]["pattern"] == {"Regex": "\\s+"} and norm[1]["content"] == " "
    cut = split.get("type") == "Split" and split["pattern"] == {"Regex": PIECE} and split["behavior"] == "Removed" and split["invert"]
    return bool(plain and cut and all("<|" in t["content"] for t in spec["added_tokens"]))


def parts(word: bytes) -> tuple[bytes, ...]:
    """Pieces whose ids follow each other: A-Z lower-cased as the vocabulary does anyway, and closing marks after an
    ASCII letter or digit apart, where its splitter cuts too. Words with <| may be special tokens: whole."""
    if b"<|" in word:
        return (word,)
    low = word.lower()
    core = low.rstrip(b".,|!#*%$&;:?")
    return (core, low[len(core) :]) if core and len(core) < len(low) and core[-1:].isalnum() else (low,)


def encoder(path: str, most: int = KEPT) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def pieces(ids: bytes, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) for each run of at most `most` ids."""
    for k, at in enumerate(range(0, len(ids) // 4, most)):
        yield k, at, ids[at * 4 : (at + most) * 4]


def vocabulary() -> str:
    """Path of the default public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
