"""Whole-text encoding inside tasks with a public tokenizer file; words seen before come from a memo of bounded bytes, which a
task empties when it ends."""

from __future__ import annotations

import array
import json
import re

#: Bytes of a memo, and what an entry takes beside its word and its ids.
MEMO_BYTES = 48_000_000
ENTRY_BYTES = 190
BATCH = 20_000
#: The normalizer and splitter of the word-level tokenizer file, for which short cuts are valid.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same splitter on lower-cased printable ASCII and Latin-1 letters, where it is plain.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ \t\n\r]*")
PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t\n\r]+")


def split_words(text: str) -> list[str]:
    """Words between blanks that the tokenizer drops; other blanks stay inside a word."""
    return [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]


class WordEncoder:
    """Encodes words between plain blanks. Valid for tokenizers that drop white space and never merge across it.

    Plain words are cut by an equivalent of the file's own splitter and go straight to its merges; all others take the whole
    way through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        split, *bytes_ = parts["pre_tokenizer"].get("pretokenizers", [{}])
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.short_cut = all(a.startswith("<|") for a in self.added) and parts["normalizer"] == NORMALIZER and split.get("pattern") == {"Regex": SPLITTER} and [b["type"] for b in bytes_] == ["ByteLevel"]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(0xDF, 0x100)])}
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        """Empty the memo."""
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, as the library gives them."""
        out: list[list[int] | None] = [None] * len(words)
        rest = []
        letters, tokenize = self.letters, self.model.tokenize
        for i, word in enumerate(words):
            if self.short_cut and "<|" not in word and PLAIN.fullmatch(word):
                parts = PLAIN_PARTS.findall(word.lower())
                out[i] = [t.id for part in parts for t in tokenize(part.translate(letters))]
            else:
                rest.append(i)
        for at in range(0, len(rest), BATCH):
            some = rest[at : at + BATCH]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def _plain(self, text: str) -> bool:
        return self.short_cut and "<|" not in text and PLAIN_TEXT.fullmatch(text) is not None

    def words(self, text: str) -> list[str]:
        """The text as words that can be encoded one by one: the splitter's own in plain texts, else what stands between blanks."""
        return PLAIN_PARTS.findall(text.lower()) if self._plain(text) else split_words(text)

    def _remember(self, own: dict[str, bytes]) -> None:
        """Take words into the memo, which is emptied when they would not fit."""
        more = sum(len(w) + len(ids) for w, ids in own.items()) + ENTRY_BYTES * len(own)
        if self.held + more > MEMO_BYTES:
            self.clear()
        if more <= MEMO_BYTES:
            self.memo.update(own)
            self.held += more

    def id_bytes(self, text: str) -> bytes:
        """The ids of the text, each as four little-endian bytes."""
        if self._plain(text):
            return self._plain_id_bytes(text)
        words = split_words(text)
        found = list(map(self.memo.get, words))
        if None not in found:
            return b"".join(found)
        unknown = list({w for w, ids in zip(words, found) if ids is None})
        own = {w: array.array("I", ids).tobytes() for w, ids in zip(unknown, self.encode_words(unknown))}
        self._remember(own)
        return b"".join([own[w] if ids is None else ids for w, ids in zip(words, found)])

    def _plain_id_bytes(self, text: str) -> bytes:
        """The same for a plain text, cut at blanks first: what stands between them is mostly one word, which needs no splitter.

        The memo holds what the splitter gives; of other pieces, such as a word and a full stop, only the parts. Bytes of plain
        ASCII stand for themselves.
        """
        pieces = text.lower().split()
        memo = self.memo
        found = list(map(memo.get, pieces))
        if None not in found:
            return b"".join(found)
        letters, tokenize = self.letters, self.model.tokenize
        own: dict[str, bytes] = {}
        joined: dict[str, bytes] = {}
        for piece in {w for w, ids in zip(pieces, found) if ids is None}:
            if piece.isalpha():
                parts = [piece]
            elif piece[-1] in ".," and piece[:-1].isalpha():
                parts = [piece[:-1], piece[-1]]
            else:
                parts = PLAIN_PARTS.findall(piece)
            made = []
            for part in parts:
                ids = memo.get(part) or own.get(part)
                if ids is None:
                    ids = own[part] = array.array("I", [t.id for t in tokenize(part if part.isascii() else part.translate(letters))]).tobytes()
                made.append(ids)
            joined[piece] = made[0] if len(made) == 1 else b"".join(made)
        self._remember(own)
        return b"".join([joined[w] if ids is None else ids for w, ids in zip(pieces, found)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
