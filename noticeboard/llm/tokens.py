"""Token ids of whole texts by a public tokenizer file, for use inside tasks.

Where a tokenizer drops white space and never joins across it, a text's ids are those of its space-separated chunks in a row. Chunks
recur far more often than they are new, so a bounded memory of encoded chunks does most of the work. Where the file states the usual split and
merges of words with an end mark, a new chunk of common characters is cut into its words, and a word's merges are worked out by the other
library for such vocabularies, which is given the file's own entries. Both ways are tried on load; files that do not fit encode whole texts.
"""
from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

MEMORY_BYTES = 96_000_000         # of remembered chunks in a worker, about; when half of it is full, what was not used since the last time goes
_TOGETHER = 16                    # texts whose new chunks are learned at once: few, so that what was just looked up is still near
_ENTRY = 180                      # bytes that a remembered chunk takes besides its letters and ids
# --- fixed values: how files of this kind split a text, as they state it, and the mark of a word's end ---
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# ------------------------------------------------------------------------------------------------------------
COMMON_CHARACTERS = "\u0180"      # below it letters, digits, blanks and their lower case are beyond doubt; a test compares every one
_END = b"\xff"                    # stands for the end mark: no text has this byte
_PROBES = ("A b  C\td\n\x0b\x0c\re", "Hello, World's  end of 2024!", "don't stopé ÉTÉ x_y", " lead and trail ", "a.b,c;d  (e) [f] --g they'll've 'S", "\U0001F600\U0001F600 中文 ok",
           "notwithstanding unbelievable antidisestablishmentarianism straße naïve ²x½ ªº")
_CODECS: dict[str, "Codec"] = {}


def _byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable Latin-1 as it is, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Words:
    """Ids of single words from a file's merges; a word's last byte and its end mark are joined before anything else."""

    def __init__(self, spec: dict):
        import tiktoken

        alphabet, vocab = _byte_alphabet(), spec["model"]["vocab"]
        as_bytes = lambda t: bytes(alphabet[c] for c in t.removesuffix(WORD_END)) + (_END if t.endswith(WORD_END) else b"")
        letters = {b: c for c, b in alphabet.items()}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        entries = [letters[b] for b in range(256)] + [letters[b] + WORD_END for b in range(256)] + made
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256)} | {as_bytes(t): 512 + i for i, t in enumerate(made)}
        if len(ranks) != len(entries):
            raise ValueError("two merges make the same entry")
        self.ids = [vocab[t] for t in entries]
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        kind = lambda k: "".join(re.escape(chr(c)) for c in range(ord(COMMON_CHARACTERS)) if unicodedata.category(chr(c)).startswith(k))
        letter, number = kind("L"), kind("N")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\\t-\\r \\x85\\xa0{letter}{number}]+").findall

    @staticmethod
    def fits(spec: dict) -> bool:
        stated = [(x.get("pattern") or {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers") or ()]
        lowers = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers") or ())
        return SPLIT in stated and lowers and spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == WORD_END and not spec["model"].get("dropout")

    def encode(self, word: bytes) -> list[int]:
        return [self.ids[r] for r in self.merge(word + _END)]


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = Words(spec) if Words.fits(spec) else None
        self._forget()
        tried = [np.array(x, self.kind) for x in self._ids(_PROBES)]
        fits = lambda: all(map(np.array_equal, self._by_chunk(list(_PROBES)), tried))
        if self.words and not fits():
            self.words = None
            self._forget()
        self.by_chunk = fits()

    def _forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}          # the older half of the memory
        self.bytes = 0

    def _keep(self, chunk: bytes, ids: bytes) -> bytes:
        self.known[chunk] = ids
        self.bytes += _ENTRY + len(chunk) + len(ids)
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of one word; the same word often stands in several chunks."""
        raw = word.encode()
        if not word.isascii():
            return array(self.kind.char, self.words.encode(raw)).tobytes()
        ids = self.known.get(raw) or self.before.get(raw)
        return self._keep(raw, array(self.kind.char, self.words.encode(raw)).tobytes()) if ids is None else ids

    def _ids(self, texts) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, new: set[bytes]) -> None:
        before, rest = self.before, []
        for chunk in new:
            ids = before.get(chunk)
            if ids is not None:
                self._keep(chunk, ids)
                continue
            if self.words is not None and chunk.isalpha():          # ASCII letters alone are one word
                self._keep(chunk, array(self.kind.char, self.words.encode(chunk.lower())).tobytes())
                continue
            text = chunk.decode()
            if self.words is None or b"<|" in chunk or not (text.isascii() or max(text) < COMMON_CHARACTERS):
                rest.append(chunk)
                continue
            self._keep(chunk, b"".join([self._word(w) for w in self.words.split(text.lower())]))
        for chunk, ids in zip(rest, self._ids(c.decode() for c in rest)):
            self._keep(chunk, np.array(ids, self.kind).tobytes())

    def _by_chunk(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), _TOGETHER):
            chunked, new = [], set()
            if 2 * self.bytes > MEMORY_BYTES:
                self.known, self.before, self.bytes = {}, self.known, 0
            known = self.known
            for text in texts[at:at + _TOGETHER]:
                raw = (text or "").encode()
                if b"<|" not in raw:          # a special token's name counts only as it is written
                    raw = raw.lower()
                chunks = raw.split()          # at 0x20 and 0x09-0x0D alone, which the tokenizer drops as well
                chunked.append(chunks)
                new |= set(chunks).difference(known)
            if new:
                self._learn(new)
            out += [np.frombuffer(b"".join(map(known.__getitem__, chunks)), self.kind) for chunks in chunked]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        return self._by_chunk(texts) if self.by_chunk else [np.array(x, self.kind) for x in self._ids(t or "" for t in texts)]


def codec(path: str) -> Codec:
    """One codec per worker and tokenizer file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batches(frames, column: str, most: int = 8_000_000):
    """Cut pandas batches so that about ``most`` characters are encoded at once; a longer single text makes a batch of its own."""
    for frame in frames:
        if len(frame):
            group = np.cumsum(frame[column].str.len().fillna(0).to_numpy()) // most
            for _, part in frame.groupby(group, sort=True):
                yield part
