"""Exact tokenization of long texts, piece by piece, with the tokenizers library.

A text is cut at single spaces, where the tokenizer's own rules cut it anyway, so that
the pieces' ids in a row are the text's ids. All texts of a block are cut first; the
library then encodes the pieces that are new in one call, and each text is put together
from a table of known pieces. Neither long texts nor large vocabularies fill memory.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Characters of a text that are split at once, and characters of texts whose pieces are looked up together.
STRETCH, TOGETHER = 1 << 18, 4 << 20
#: Pieces kept encoded, and characters of all of them, about.
KEPT, KEPT_CHARS = 1_200_000, 20_000_000
#: Pieces given to the library in one call, and plain ones in one string.
CALL, JOINED = 16_384, 256
#: ASCII signs that end a plain piece, none of which is part of a contraction.
SIGNS = ".,;:!?%&$#*+-/=()[]{}<>@\\^_`|~\""
_CUT = re.compile(r"(?= \S)")
_LOADED: dict[str, PieceEncoder] = {}


class _Pieces(dict):
    """Numbers of pieces; one that is asked for first gets the next number and is listed in new."""

    def __init__(self):
        self.new: list[str] = []
        self.given = 0

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.given
        self.given += 1
        self.new.append(piece)
        return n


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A piece is what stands between two spaces. Where the tokenizer keeps a space with the
    word after it, pieces are encoded with it; the key of a piece without a space before
    it then begins with one, which no other key does. The ids of all known pieces stand in
    one array, and a block of texts is put together by one gather.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.drops_space = _drops_space(rules)
        self.lowers = any(s.get("type") == "Lowercase" for s in (rules.get("normalizer") or {}).get("normalizers", []))
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.largest_id + 1)]
        tail = rules["model"].get("end_of_word_suffix") or "\0"
        #: Ids that end a word, or, where a space stays with the word after it, ids that begin with a space.
        self.edge = np.array([n.endswith(tail) if self.drops_space else n.startswith("\u0120") for n in names])
        self._clear()

    def _clear(self) -> None:
        self.known = _Pieces()
        self.chars = 0
        #: All ids, and where each piece's begin and how many they are.
        self.ids, self.filled = np.zeros(1 << 16, "<u4"), 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        #: How often each piece was asked for since pieces were last dropped.
        self.uses = np.zeros(1 << 16, np.int64)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    @property
    def largest_id(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True) - 1

    def stretches(self, text: str) -> Iterator[str]:
        """The text in stretches of about STRETCH characters, cut at spaces with no white space after them."""
        at = 0
        while len(text) - at > STRETCH:
            cut = text.rfind(" ", at + 1, at + STRETCH)
            while cut > at and (cut + 1 >= len(text) or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                found = _CUT.search(text, at + STRETCH)
                cut = found.start() if found else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _pieces(self, text: str) -> list[str]:
        if self.drops_space:
            # Fewer different pieces; beyond ASCII the library's own lower case may be another.
            return (text.lower() if self.lowers and text.isascii() else text).replace("\n", " ").split(" ")
        pieces = text.split(" ")
        pieces[0] = " " + pieces[0]
        return pieces

    def _odd(self, key: str) -> bool:
        """Whether white space stands on both sides of the cut before a piece, so that it may be no cut."""
        return not self.drops_space and (not key or key[0].isspace() and key[0] != " ")

    def _careful(self, text: str) -> list[str]:
        """Keys of pieces that begin with a space and no second white space."""
        return [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else " " + p for p in _CUT.split(text) if p]

    def _words(self, key: str) -> int:
        """Edges that a plain piece has at least; 0 for a piece that is not plain.

        Normalisation may split a letter in two words, so there may be more, but not fewer.
        """
        if not self.drops_space:
            return int(key[:1] != " ")
        letters = key.rstrip(SIGNS)
        return 1 + (len(letters) < len(key)) if letters.isalpha() else 0

    def _store(self, numbers: list[int] | np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds the ids of the pieces of these numbers, which stand in ids one after the other."""
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while self.known.given > len(self.at):
            self.at, self.count, self.uses = (np.append(x, np.zeros_like(x)) for x in (self.at, self.count, self.uses))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.at[numbers] = self.filled + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.filled += len(ids)

    def _learn(self) -> None:
        """Encodes new pieces: plain ones side by side in one string, whose ids their edges tell apart."""
        new, self.known.new = self.known.new, []
        find = self.known.__getitem__
        self.chars += sum(map(len, new))
        words = list(map(self._words, new))
        plain, others = [k for k, n in zip(new, words, strict=True) if n], [k for k, n in zip(new, words, strict=True) if not n]
        need = np.array([n for n in words if n], np.int64)
        for i in range(0, len(plain), CALL):
            starts = range(i, min(i + CALL, len(plain)), JOINED)
            asked = [" ".join(plain[j : j + JOINED]) if self.drops_space else " " + " ".join(plain[j : j + JOINED]) for j in starts]
            for j, e in zip(starts, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False), strict=True):
                part, ids = plain[j : j + JOINED], np.array(e.ids, dtype="<u4")
                edges, ends = np.flatnonzero(self.edge[ids]), np.cumsum(need[j : j + JOINED])
                if len(edges) != ends[-1]:
                    others += part
                    continue
                cuts = np.append(0, edges[ends - 1] + 1) if self.drops_space else np.append(edges, len(ids))
                self._store(list(map(find, part)), ids, np.diff(cuts))
        for i in range(0, len(others), CALL):
            part = others[i : i + CALL]
            asked = part if self.drops_space else [k[1:] if k[:1] == " " else " " + k for k in part]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)]
            self._store(list(map(find, part)), np.fromiter(chain.from_iterable(got), "<u4"), np.array(list(map(len, got)), np.int64))

    def _drop(self) -> None:
        """Forgets the pieces that were asked for least, half of those kept at least."""
        names, numbers = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        uses, at, counts = self.uses[numbers], self.at[numbers], self.count[numbers]
        least = 2
        while (uses >= least).sum() > KEPT // 2:
            least *= 2
        stay = np.flatnonzero(uses >= least)
        old = self.ids
        self._clear()
        self.known.update(zip([names[i] for i in stay.tolist()], range(len(stay)), strict=True))
        self.known.given = len(stay)
        self.chars = sum(map(len, self.known))
        counts = counts[stay]
        begin = np.cumsum(counts) - counts
        self._store(np.arange(len(stay)), old[np.repeat(at[stay] - begin, counts) + np.arange(int(counts.sum()))], counts)

    def _numbers(self, split: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))

    def _together(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT or self.chars > KEPT_CHARS:
            self._drop()
        split = [self._pieces(t) for t in texts]
        numbers = self._numbers(split)
        odd = {k for k in self.known.new if self._odd(k)}
        if odd:
            split = [p if odd.isdisjoint(p) else self._careful(t) for p, t in zip(split, texts, strict=True)]
            for k in odd:
                del self.known[k]
            self.known.new = [k for k in self.known.new if k not in odd]
            numbers = self._numbers(split)
        self._learn()
        self.uses[: self.known.given] += np.bincount(numbers, minlength=self.known.given)
        counts = self.count[numbers]
        total = int(counts.sum())
        begin = np.cumsum(counts) - counts
        got = self.ids[np.repeat(self.at[numbers] - begin, counts) + np.arange(total)].tobytes()
        ends = np.cumsum([0, *map(len, split)])
        edge = (4 * np.append(begin, total)[ends]).tolist()
        return [got[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; a null text has none."""
        held: list[str] = []
        ends: list[int] = []
        size = 0

        def settle() -> Iterator[bytes]:
            got = self._together(held)
            a = 0
            for b in ends:
                yield got[a] if b == a + 1 else b"".join(got[a:b])
                a = b

        for text in texts:
            held += self.stretches(text or "")
            ends.append(len(held))
            size += len(text or "")
            if size >= TOGETHER:
                yield from settle()
                held, ends, size = [], [], 0
        if ends:
            yield from settle()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def _drops_space(rules: dict) -> bool:
    """Whether the rules read white space only as a gap between words: runs of it become one space, and what is split out holds none."""
    first = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    one_space = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    return one_space and split and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
