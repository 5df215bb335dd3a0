"""Encoding of whole texts with a public tokenizer file, word by word through a memo.

Both vocabularies cut a text before their merges, and never join what stands on two sides
of a single space.  So a text's ids are those of its words in turn, and a word met before
need not be encoded again.  The memo belongs to the worker process.  When it is full it becomes
the older memo, from which words still in use move to the new one.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np

from ledgerwake.llm.shared import kept

# Words held by each of the two memos, about 200 bytes each, and words looked up in one go.
MEMO, GROUP = 350_000, 250_000
# Words that stand in one text when they are encoded, and texts of one call.
IN_TEXT, AT_ONCE = 256, 64
# Marks the bounds of words for a vocabulary that drops spaces; one id of its own.
_MARK = "\0"
# From this letter on, lower-casing or composing may end a word in something else than a letter.
_FIRST_UNSURE = 0x130

_SPACE_RUN = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
# Python calls these white space, the tokenizers don't.
_SEPARATORS = re.compile("[" + "".join(map(chr, range(0x1C, 0x20))) + "]")
_UNICODE_SPACES = "".join(
    map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)))
) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NOT_SPACE = re.compile(f"[^{_UNICODE_SPACES}]+")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Strings of special tokens inside a text get the ids of those tokens, as in the library's
    plain call, or are ordinary text if `special_as_text`.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts are cut at special tokens before words are looked up; words hold none.
        self.tokenizer.encode_special_tokens = True
        self.special: dict[str, bytes] = {}
        if not special_as_text:
            for n, token in self.tokenizer.get_added_tokens_decoder().items():
                self.special[token.content] = np.array([n], dtype="<u4").tobytes()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # A vocabulary without normaliser keeps spaces: a word includes the space before it.
        self.keeps_spaces = self.tokenizer.normalizer is None
        if self.keeps_spaces:
            self.sizes = np.array([len(b) for b in token_bytes(path)])
        else:
            self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not any(mark in text for mark in self.special for text in texts):
            return self._encode_plain(texts)
        cut = [self.at_special.split(text) for text in texts]
        # Special tokens stand at the odd places.
        plain = iter(self._encode_plain([piece for pieces in cut for piece in pieces[::2]]))
        return [
            b"".join(self.special[p] if n % 2 else next(plain) for n, p in enumerate(pieces))
            for pieces in cut
        ]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        words = self._spaced(texts) if self.keeps_spaces else self._folded(texts)
        out, start = [], 0
        for stop in self._groups(words):
            group = words[start:stop]
            self._learn(group)
            get = self.memo.__getitem__
            out += [b"".join(map(get, one)) for one in group]
            start = stop
        return out

    @staticmethod
    def _groups(words: list[list[str]]) -> list[int]:
        """Ends of runs of texts that together have at most GROUP words, or of a longer text."""
        ends, count = [], 0
        for n, one in enumerate(words):
            if count and count + len(one) > GROUP:
                ends.append(n)
                count = 0
            count += len(one)
        return [*ends, len(words)] if words else []

    def _learn(self, group: list[list[str]]) -> None:
        wanted = set().union(*group)
        fresh = wanted.difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO:
            self.older, self.memo, fresh = self.memo, {}, wanted
        # Membership is asked word by word: set methods would walk through the whole memo.
        older, unknown = self.older, []
        for word in fresh:
            if word in older:
                self.memo[word] = older[word]
            else:
                unknown.append(word)
        cut, wanted = [], set()
        for word in unknown:
            # Punctuation after a letter is a piece of its own, so the two are encoded apart.
            stem = word.rstrip(string.punctuation)
            if stem and stem != word and stem[-1].isalpha() and ord(stem[-1]) < _FIRST_UNSURE:
                cut.append((word, stem, word[len(stem) :]))
                wanted.update(cut[-1][1:])
            else:
                wanted.add(word)
        unknown = []
        for word in wanted:
            if word in older:
                self.memo[word] = older[word]
            elif word not in self.memo:
                unknown.append(word)
        self._encode_words(unknown)
        for word, stem, rest in cut:
            self.memo[word] = self.memo[stem] + self.memo[rest]

    def _encode_words(self, words: list[str]) -> None:
        """Encodes many words in one text where their ids can be told apart, else one by one."""
        fits = self._spaced_fits if self.keeps_spaces else self._folded_fits
        joined, lone = [], []
        for word in words:
            (joined if fits(word) else lone).append(word)
        groups = [joined[n : n + IN_TEXT] for n in range(0, len(joined), IN_TEXT)]
        between = "" if self.keeps_spaces else f" {_MARK} "
        for start in range(0, len(groups), AT_ONCE):
            part = groups[start : start + AT_ONCE]
            found = self.tokenizer.encode_batch_fast(
                [between.join(g) for g in part], add_special_tokens=False
            )
            for group, one in zip(part, found):
                ids = np.array(one.ids, dtype="<u4")
                bounds = self._bounds(group, ids)
                if bounds is None:
                    lone += group
                    continue
                raw = ids.tobytes()
                self.memo.update(
                    (w, raw[4 * a : 4 * b]) for w, a, b in zip(group, *(b.tolist() for b in bounds))
                )
        for start in range(0, len(lone), IN_TEXT):
            part = lone[start : start + IN_TEXT]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            for word, one in zip(part, found):
                self.memo[word] = np.array(one.ids, dtype="<u4").tobytes()

    def _bounds(self, group: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Where the ids of each word begin and end; None if they don't come apart."""
        if not self.keeps_spaces:
            at = np.flatnonzero(ids == self.mark[0])
            if len(at) != len(group) - 1:
                return None
            return np.concatenate([[0], at + 1]), np.concatenate([at, [len(ids)]])
        upto = np.cumsum(self.sizes[ids])
        ends = np.cumsum([len(w.encode()) for w in group])
        last = np.searchsorted(upto, ends)
        if last[-1] >= len(ids) or (upto[last] != ends).any():
            return None
        return np.concatenate([[0], last[:-1] + 1]), last + 1

    @staticmethod
    def _spaced_fits(word: str) -> bool:
        """A single space, then no space at either end: texts are cut before such a word."""
        return len(word) > 1 and word[0] == " " and not (word[1].isspace() or word[-1].isspace())

    def _folded_fits(self, word: str) -> bool:
        return _MARK not in word and len(self.mark) == 1

    @staticmethod
    def _spaced(texts: list[str]) -> list[list[str]]:
        out = []
        for text in texts:
            cut = _SINGLE_SPACE.split(text) if _SPACE_RUN.search(text) else text.split(" ")
            out.append([cut[0], *[" " + w for w in cut[1:]]] if text else [])
        return out

    @staticmethod
    def _folded(texts: list[str]) -> list[list[str]]:
        out = []
        for text in texts:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass  # the normaliser lowers words whose lower case may depend on more
            out.append(_NOT_SPACE.findall(text) if _SEPARATORS.search(text) else text.split())
        return out


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    key = ("encoder", path, special_as_text)
    return kept(key, lambda: Encoder(path, special_as_text))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}
    tokenizer = Tokenizer.from_file(path)
    out = []
    for n in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(n)
        known = all(c in back for c in token)
        out.append(bytes(back[c] for c in token) if known else token.encode())
    return out
