"""Byte-pair encoding by one dynamic programme over prefixes.

Every prefix of a unit (a piece of text that merges never cross) has exactly
one encoding, so it has one last token. An automaton over all tokens lists the
tokens that end at a position; the last token is the one that may follow the
last token of what stands before it. Whether two tokens may stand next to each
other is decided from the merge list alone, by undoing the later of both
tokens' merges and looking for an earlier merge across the seam. Following the
last tokens backwards gives the ids.
"""

from __future__ import annotations

import json
import re

import ahocorasick
from tokenizers import Tokenizer

#: Fixed value: the characters that the tokenizer's text rules take as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Fixed value: the tokenizer's split pattern, for lower-case text below U+0100 (there no Unicode version differs).
LATIN = [chr(k) for k in range(256)]
SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{0}{1}{2}]+".format(
        "".join(c for c in LATIN if c.isalpha()), "".join(c for c in LATIN if c.isnumeric()), WHITE_SPACE
    )
)
#: Pieces, and units, whose encoding a worker remembers; beyond, it forgets all and goes on.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class Merges:
    """A merge list: base symbols 0..n-1, and one further symbol for each merge in order."""

    def __init__(self, base: int, pairs: list[tuple[int, int]]):
        self.base = base
        self.parts = [(k, k) for k in range(base)] + pairs
        self.joined = {}
        for k, pair in enumerate(pairs):
            self.joined.setdefault(pair, base + k)
        self.letters = [(k,) for k in range(base)]
        for a, b in pairs:
            self.letters.append(self.letters[a] + self.letters[b])
        self.seams: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        reached = [True] * base
        for token, letters in enumerate(self.letters):
            left, right = self.parts[token]
            if token >= base:
                reached.append(reached[left] and reached[right] and self.fits(left, right, before=token))
            if reached[token]:
                word = "".join(map(chr, letters))
                self.whole[word] = token
                self.automaton.add_word(word, (len(word), token))
        self.automaton.make_automaton()

    def fits(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging the text of left + right yields just these two, looking only at merges earlier than `before`."""
        parts, joined = self.parts, self.joined
        bound = len(parts) if before is None else before
        while True:
            across = joined.get((left, right))
            if across is not None and across < bound:
                return False
            # undo the later merge; on a tie the one to the right, as merging goes from left to right
            for side in (0, 1) if left > right else (1, 0):
                if side == 0 and left >= self.base:
                    bound, left = left, parts[left][1]
                    break
                if side == 1 and right >= self.base:
                    bound, right = right + 1, parts[right][0]
                    break
            else:
                return True

    def encode(self, unit: str) -> list[int]:
        """Tokens of a unit whose characters are base symbols (chr(k) for symbol k)."""
        if (token := self.whole.get(unit)) is not None:
            return [token]
        seams, last = self.seams, [-1] * (len(unit) + 1)
        if len(seams) >= REMEMBERED:
            seams.clear()
        width = [0] * len(last)
        for at, (length, token) in self.automaton.iter(unit):
            end = at + 1
            if last[end] < 0:
                if length < end:
                    if (before := last[end - length]) < 0:
                        continue
                    seam = before << 32 | token
                    if (fits := seams.get(seam)) is None:
                        fits = seams[seam] = self.fits(before, token)
                    if not fits:
                        continue
                last[end], width[end] = token, length
        tokens, end = [], len(unit)
        while end:
            tokens.append(last[end])
            end -= width[end]
        return tokens[::-1]


class WordEndBpe:
    """A lower-casing BPE tokenizer with word ends, read from its JSON description."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        symbols = letters + [x + end for x in letters]
        number = {name: k for k, name in enumerate(symbols)}
        pairs = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((number[a], number[b]))
            number.setdefault(a + b, len(symbols))
            symbols.append(a + b)
        self.merges = Merges(512, pairs)
        self.ids = [str(vocab[name]) for name in symbols]
        self.special = {t["content"]: str(t["id"]) for t in spec["added_tokens"]}
        self.names = dict(zip(self.ids, symbols)) | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.space = re.compile(f"[{WHITE_SPACE}]+")
        self.symbol_of = {ord(x): k for k, x in enumerate(letters)}
        rules = Tokenizer.from_file(path)  # only its Unicode tables: normal form, case and character classes
        self.normal, self.units = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.known: dict[str, tuple[int, str]] = {}
        self.known_units: dict[str, tuple[int, str]] = {}

    def _piece(self, piece: str) -> tuple[int, str]:
        """Count and ids of a piece without white space."""
        if max(piece, default="") < "\u0100":
            units = [unit.encode().decode("latin-1") for unit in SPLIT.findall(piece.lower())]
        else:
            units = [unit.translate(self.symbol_of) for unit, _ in self.units(self.normal(piece))]
        found = [self.known_units.get(unit) or self._unit(unit) for unit in units]
        if len(found) == 1:
            return found[0]
        return sum(f[0] for f in found), " ".join([f[1] for f in found])

    def _unit(self, unit: str) -> tuple[int, str]:
        """The same of a unit, given as one character for each byte."""
        if len(self.known_units) >= REMEMBERED:
            self.known_units.clear()
        tokens = self.merges.encode(unit[:-1] + chr(256 + ord(unit[-1])))
        found = len(tokens), " ".join([self.ids[t] for t in tokens])
        self.known_units[unit] = found
        return found

    def _pieces(self, text: str):
        for part in self.cut.split(text) if self.special else [text]:
            if part in self.special:
                yield (1, self.special[part])
                continue
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            for piece in self.space.split(part) if odd else part.split():
                found = self.known.get(piece)
                if found is None:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    found = self.known[piece] = self._piece(piece)
                if found[0]:
                    yield found

    def encode(self, text: str | None) -> tuple[int, str]:
        """Number of tokens, and ids joined by one space."""
        found = list(self._pieces(text or ""))
        return sum(f[0] for f in found), " ".join([f[1] for f in found])

    def decode(self, ids: str) -> str:
        """The tokens' names joined by a space, as for a tokenizer that has no decoder; specials stay."""
        return " ".join([self.names[i] for i in ids.split()])
