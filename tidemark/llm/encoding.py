"""Token ids of whole texts, by the tokenizers library, each distinct word encoded once.

The pre-tokenizers of byte-level and word BPE cut a text at a single space or line feed between
two other characters, so words can be encoded by themselves. Words repeat: the ids of
``CACHE_WORDS`` of them, of up to ``CACHE_LENGTH`` characters, are kept per Python worker. A new word of plain letters and punctuation
is cut into runs of either, as the pre-tokenizer would, and the library's model encodes the
runs; any other word goes through the whole tokenizer. So do whole texts that hold other white
space around a space or line feed or a special token's string, and every text of a tokenizer
whose pre-tokenizer is neither of the two. The ids are those of encoding every text in one go,
which tests/llm checks.
"""

import json
import os
import re
from array import array
from functools import cache

import numpy as np

#: Distinct words, and a quarter as many runs, that a Python worker keeps; beyond it a cache starts
#: anew.
CACHE_WORDS = 500_000
#: Longer words and runs are encoded each time they come.
CACHE_LENGTH = 64

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PUNCTUATION = r".,;:!?%$#&*()\"|@\-"
_RUNS = re.compile(f"[{_LETTERS}]+|[{_PUNCTUATION}]+")
_PLAIN = re.compile(f"[{_LETTERS}{_PUNCTUATION}]+")

#: The split pattern of the word BPE whose words are cut as above; a fixed value.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words(dict):
    """Ids of words, learned at the first look-up."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """``encode(text)`` gives an array of ids, of the smallest unsigned type that holds them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.dtype = np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space, self.lowers = False, False
        self.by_word = self._known(json.loads(self.tokenizer.to_str()))
        # How the byte level writes each plain character, by the library itself.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in range(33, 256) if _PLAIN.fullmatch(chr(c))]
        self.written = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in [" ", *plain]})
        self.feed = self._whole("\n").tobytes()
        #: How the model takes the space before a word, if it keeps it.
        self.space = " ".translate(self.written) if self.keeps_space else ""
        self.pieces = Words(self._learn)
        #: Runs that no space comes before, as the model takes them.
        self.runs: dict[str, bytes] = {}

    def _known(self, config: dict) -> bool:
        """Whether words may be encoded by themselves; how the text is prepared for the model."""
        if any(t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        before, prepare = config["pre_tokenizer"] or {}, config["normalizer"]
        if before.get("type") == "ByteLevel" and prepare is None:
            self.keeps_space = True
            return before["use_regex"] and not before["add_prefix_space"]
        steps = [s["type"] for s in (prepare or {}).get("normalizers", [])]
        cuts = before.get("pretokenizers", [])
        self.lowers = "Lowercase" in steps
        return (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"] == {"Regex": _WORD_SPLIT}
            and cuts[0]["invert"]
            and cuts[0]["behavior"] == "Removed"
            and not cuts[1]["use_regex"]
            and not cuts[1]["add_prefix_space"]
        )

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _ids(self, run: str) -> bytes:
        """The ids of a run as the model takes it."""
        return array(self.code, [t.id for t in self.model.tokenize(run)]).tobytes()

    def _run(self, run: str) -> bytes:
        """The same for a run that no space comes before, kept."""
        known = self.runs.get(run)
        if known is None:
            known = self._ids(run)
            if len(run) <= CACHE_LENGTH:
                if len(self.runs) >= max(1, CACHE_WORDS // 4):
                    self.runs.clear()
                self.runs[run] = known
        return known

    def _learn(self, piece: str) -> bytes:
        """The ids of a new piece; an error if it isn't a word free of white space."""
        begins = piece[:1] == "\n"
        word = piece[1:] if begins else piece
        letters = word.isascii() and word.isalpha()
        if letters or _PLAIN.fullmatch(word):
            plain = word.lower() if self.lowers else word
            if letters and plain == word and not begins:
                return self._ids(self.space + word)
            if plain != word:
                return self.pieces["\n" + plain if begins else plain]
            first, *rest = _RUNS.findall(plain)
            written = [r if r.isascii() else r.translate(self.written) for r in rest]
            if begins:
                start = self.feed + self._run(first.translate(self.written))
            elif rest:
                start = self.pieces[first]
            else:
                return self._ids(self.space + first.translate(self.written))
            return start + b"".join(map(self._run, written))
        if len(word.split()) == 1 and len(word.split()[0]) == len(word):
            return self._whole(piece if begins else " " + word).tobytes()
        raise ValueError("white space beside a space or line feed")

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if not self.by_word or any(s in text for s in self.specials):
            return self._whole(text)
        # A piece is a word after a space, or a line feed and the word after it. The first word
        # is looked up as if a line feed came before.
        pieces = f"\n{text}".replace("\n", " \n")[1:].split(" ")
        try:
            found = list(map(self.pieces.__getitem__, pieces))
        except ValueError:
            return self._whole(text)
        found[0] = found[0][len(self.feed) :]
        return np.frombuffer(b"".join(found), self.dtype)


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer file; the file is on every machine."""
    return Encoder(path)


def public_path(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
