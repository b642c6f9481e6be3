"""Token ids of whole texts by a ``tokenizers`` file, with a bounded word cache.

The pre-tokenizer of byte-level BPE files makes a space between two
non-spaces open the next piece, and a line break between two non-spaces a
piece of its own.  So a text can be cut before such spaces and breaks, and the ids of
the words joined.  Words recur, which turns most of the work into dictionary
lookups.  Inside a word, letters and the ASCII signs after them are pieces as
well.  The letters of unknown words go to the file's BPE model many at a
time, one word a piece.  Text around other white space, and files with another
pre-tokenizer, are given to the library whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
import sys
import threading
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that is no cut: more of it, the end or the front of the text is next to it.
_INNER = re.compile(r"\s(?:\s|\Z)|\A\s")
_SPACE = re.compile(r"\s")
#: A line break or none, Latin letters, ASCII signs (not the apostrophe, which may open a piece with the letters behind it).
_SHAPE = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Characters that are cut at once; words in one text and texts in one call of the model.
_AT_ONCE, _IN_TEXT, _IN_CALL = 3_000_000, 100, 200
assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are kept as little-endian uint32"


def _cuttable(text: str) -> bool:
    """Whether each space and line break stands between two characters that are no white space."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
        return False
    # only a space is both white space and printable
    return text.replace("\n", "").isprintable() or not _INNER.search(text)


class _Words:
    """Word -> its ids, bounded.  When full, the older half of what was not used since goes."""

    def __init__(self, room: int):
        self._room, self._new, self._old = room, {}, {}

    def find(self, words: list[str]) -> tuple[list[bytes | None], list[int]]:
        """The ids of each word, and the places of words that are not known."""
        out = list(map(self._new.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if self._old and missing:
            asked, unknown = [words[i] for i in missing], []
            for i, word, ids in zip(missing, asked, map(self._old.get, asked)):
                if ids is None:
                    unknown.append(i)
                else:
                    out[i] = self._new[word] = ids
            missing = unknown
        return out, missing

    def peek(self, word: str) -> bytes | None:
        return self._new.get(word)

    def learn(self, words: dict[str, bytes]) -> None:
        self._new.update(words)
        for word in [w for w in words if len(w) > 40]:
            del self._new[word]
        if len(self._new) > self._room:
            self._old, self._new = self._new, {}

    def clear(self) -> None:
        self._new, self._old = {}, {}


class Encoder:
    """``encode(text)`` and ``encode_all(texts)``: ids as little-endian uint32 bytes, equal to the library's own."""

    def __init__(self, path: str, room: int = 600_000):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self._cut = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                     and not pre.get("add_prefix_space") and spec.get("normalizer") is None
                     and spec.get("truncation") is None and spec.get("padding") is None
                     and all(not _SPACE.search(t["content"]) and not t.get("lstrip") and not t.get("rstrip")
                             and not t.get("single_word") and not t["content"].isalpha()
                             for t in spec.get("added_tokens") or []))
        self._rest, self._idle = _Words(room), None
        if self._cut:
            split = self._tok.pre_tokenizer.pre_tokenize_str      # how the file writes the bytes of a character
            self._bytes = {ord(c): split(c)[0][0] for c in map(chr, range(256)) if c.isalpha() or c == " "}
            self._space, self._line = self._bytes[ord(" ")], split("\n")[0][0]
            self._tails = {"": b""}
            self._break = self._whole("\n")
            self._cut = len(self._break) == 4
        if self._cut:
            # the same model where each line is a piece: for many plain words at a time
            pieces = {"type": "Split", "pattern": {"String": self._line}, "behavior": "Isolated", "invert": False}
            spec |= {"pre_tokenizer": pieces, "post_processor": None, "decoder": None, "added_tokens": []}
            self._pieces = Tokenizer.from_str(json.dumps(spec))

    def _whole(self, text: str) -> bytes:
        return array("I", self._tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _tail(self, signs: str) -> bytes:
        if signs not in self._tails:
            if len(self._tails) > 10_000:
                self._tails = {"": b""}
            self._tails[signs] = self._whole(signs)
        return self._tails[signs]

    def _models(self, written: list[str]) -> list[bytes]:
        """Ids of pieces as the model writes them."""
        out, line = [], int.from_bytes(self._break, "little")
        for k in range(0, len(written), _IN_TEXT * _IN_CALL):
            some = written[k:k + _IN_TEXT * _IN_CALL]
            lines = [self._line.join(some[a:a + _IN_TEXT]) for a in range(0, len(some), _IN_TEXT)]
            each = self._pieces.encode_batch_fast(lines, add_special_tokens=False)
            raw = self._break.join([array("I", x.ids).tobytes() for x in each])
            ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == line)).tolist()
            out += [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)]
        return out

    def _learn(self, unknown: list[str]) -> dict[str, bytes]:
        """Ids of words that are not known yet."""
        new, plain, shaped = {}, [], []
        for word in unknown:
            if word.isascii() and word.isalpha():
                plain.append(word)
            elif shape := _SHAPE.fullmatch(word):
                shaped.append((word, *shape.groups()))
            else:
                new[word] = self._odd(word)
        new |= zip(plain, self._models([self._space + w for w in plain]))
        # a stem after a space may be a known word; after a break it is written without the space
        stems = [new.get(letters) or self._rest.peek(letters) if signs and not first else None for _, first, letters, signs in shaped]
        missing = iter(self._models([(("" if first else self._space) + letters).translate(self._bytes) if not letters.isascii()
                                     else letters if first else self._space + letters
                                     for (_, first, letters, _), ids in zip(shaped, stems) if ids is None]))
        for (word, first, _, signs), ids in zip(shaped, stems):
            ids = next(missing) if ids is None else ids
            if signs:
                ids += self._tail(signs)
            new[word] = self._break + ids if first else ids
        self._rest.learn(new)
        return new

    def _odd(self, word: str) -> bytes:
        """A word of another shape: after a space, or after the break that it opens with."""
        if word[:1] == "\n" and word[1:]:       # such words come from cuts at breaks only
            return self._break + self._whole(word[1:])
        if "\n" in word:
            lines = word.split("\n")
            if all(x and not _SPACE.search(x) for x in lines):
                return self._break.join([self._whole(" " + lines[0]), *map(self._whole, lines[1:])])
        return self._whole(" " + word)

    def encode_all(self, texts):
        """One ``bytes`` for each text, in order; null and empty texts have no ids."""
        held, some, size = [], [], 0                 # results, or None for a text that is cut with others
        for text in texts:
            if not text:
                held.append(b"")
            elif not self._cut or not _cuttable(text):
                held.append(self._whole(text))
            else:
                held.append(None)
                some.append(text)
                size += len(text)
            if size >= _AT_ONCE or len(held) >= 100_000:
                yield from self._joined(held, some)
                held, some, size = [], [], 0
        yield from self._joined(held, some)

    def _joined(self, held: list, some: list[str]):
        ids = iter(self._by_words(some) if some else ())
        for own in held:
            yield next(ids) if own is None else own

    def _by_words(self, texts: list[str]):
        """Ids of texts that can be cut at each space and break: distinct words are looked up once."""
        lines = ["\n" + t.replace("\n", " \n") for t in texts]         # a first word stands behind a break, too
        parts = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        words = parts.flatten().dictionary_encode()
        at, distinct = words.indices, words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, missing = self._rest.find(distinct)
        if missing:
            new = self._learn([distinct[i] for i in missing])
            for i in missing:
                known[i] = new[distinct[i]]
        _, ends, tokens = pa.array(known, pa.large_binary()).take(at).buffers()      # all ids in a row, and where words end
        last = np.cumsum(pc.list_value_length(parts).to_numpy())
        start, tokens = 0, memoryview(tokens)
        for stop in np.frombuffer(ends, np.int64)[last].tolist():
            yield tokens[start + 4:stop].tobytes()   # without the break
            start = stop

    def rest(self, seconds: float = 15) -> None:
        """To be called as a task ends: the next task finds the words, but an idle Python worker soon gives all back."""
        self._idle = threading.Timer(seconds, _release, [self])
        self._idle.daemon = True
        self._idle.start()

    def forget(self) -> None:
        """Gives the word cache back: no more is held than the tokenizer."""
        self._rest.clear()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def _kept() -> dict[str, Encoder]:
    """The encoders of this Python worker.

    On the imported library: functions are shipped by value, so this module's
    own globals are new in every task.
    """
    import tokenizers

    return vars(tokenizers).setdefault("_assaygraph_encoders", {})


def _release(own: Encoder) -> None:
    """Drops an encoder that no task uses, and its memory from the process where the C library can do that."""
    kept = _kept()
    for path in [p for p, e in kept.items() if e is own]:
        del kept[path]
    own.__dict__.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python worker and kept while tasks follow each other."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
    kept = _kept()
    own = kept.get(path)
    if own is not None and own._idle is not None:
        own._idle.cancel()
        own._idle.join()                             # a release that has begun ends first
    if path not in kept:
        kept[path] = Encoder(path)
    kept[path]._idle = None
    return kept[path]


def default_path() -> str:
    """The vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
