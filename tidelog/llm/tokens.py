"""Encoding with the ``tokenizers`` library, a distinct piece of text at a time.

A tokenizer that splits a text before it merges has points that no token crosses.  Between them the library's
result depends on nothing else: each worker process runs the library's normalizer, pre-tokenizer and model on a
distinct chunk once and keeps its ids in a bounded cache.  A tokenizer of any other kind, and a text in which such points are not plain, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Sequence

import numpy as np

from tidelog.llm.memory import hold

#: Entries kept in each cache of a process, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 80
#: Letters for which the split, lower-casing and normal form are known without asking the library.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)\Z")


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level BPE shows for each byte: itself if printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, free = {}, 256
    for b in range(256):
        table[b] = chr(b if b in shown else free)
        free += b not in shown
    return table


BYTE_ALPHABET = byte_alphabet()


_BY_PATH: dict[str, ChunkEncoder] = {}
#: How common characters are in texts, roughly: the rarest of a string tells first whether a text may hold it.
RARE = "|<>[]_#*"


#: White space beside the space and the line end.
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_BLANKS = [c for c in BLANKS if c.isascii()]


def _rarest(text: str) -> str:
    return min(text, key=lambda c: RARE.find(c) % 99)


def _rough(text: str) -> bool:
    """Whether there is other white space than spaces and line ends, or blanks stand at an end or side by side."""
    if any(c in text for c in (ASCII_BLANKS if text.isascii() else BLANKS)):
        return True
    return text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text


def _kind(path: str) -> str:
    """``drops``: white space never reaches a token.  ``leads``: one space may lead a token, a lone line end is one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "leads"
    parts = pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else []
    if parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and "[^\\s" in parts[0].get("pattern", {}).get("Regex", ""):
        return "drops"
    return "whole"


class _Words(dict):
    """Words to their ids; a word that is looked up in vain is learnt, and kept unless it is long."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class ChunkEncoder:
    """Texts to ids as little-endian unsigned 32-bit integers, equal to the library's own ``encode`` of the whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library takes these strings out of a text before anything else; a text that may hold one is encoded whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(re.escape(t) for t in added), re.IGNORECASE) if added else None
        self.added_chars = {_rarest(t) for t in added if t}
        self.kind = _kind(path)
        self.model = self.tokenizer.model
        self.merged: dict[str, bytes] = {}
        self.plain, self.spaced = _Words(lambda w: self._learn(w, "")), _Words(lambda w: self._learn(w, " "))
        self.end_of_line = self._library(["\n"])[0] if self.kind == "leads" else b""

    def _library(self, parts: Sequence[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _merge(self, piece: str) -> bytes:
        """Ids of one pre-token, in the byte alphabet."""
        ids = self.merged.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece)
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if len(piece) <= CACHE_CHARS:
                self.merged[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        text = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        return b"".join([self._merge(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])

    def _learn(self, word: str, lead: str) -> bytes:
        if (m := WORD.match(word)) is None:
            return self._chunk(lead + word) if word else b""
        letters, marks = m.groups()
        if self.kind == "drops":
            letters = letters.lower()
        piece = (BYTE_ALPHABET[32] if lead else "") + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_ALPHABET))
        ids = self.merged.get(piece) or self._merge(piece)
        return ids + (self.merged.get(marks) or self._merge(marks)) if marks else ids

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 512):
            out += self._some(texts[at : at + 512])
        return out

    def _some(self, texts: Sequence[str]) -> list[bytes]:
        for cache in (self.merged, self.plain, self.spaced):
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
        if self.added is not None and self.kind != "whole":
            special = [i for i, t in enumerate(texts) if any(c in t for c in self.added_chars) and self.added.search(t)]
            if special:
                whole = dict(zip(special, self._library([texts[i] for i in special])))
                rest = iter(self._some([t for i, t in enumerate(texts) if i not in whole]))
                return [whole[i] if i in whole else next(rest) for i in range(len(texts))]
        if self.kind == "drops":
            get = self.plain.__getitem__
            return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]
        if self.kind == "leads":
            # other white space, two blanks in a row, or one at an end: such a text isn't cut plainly
            rough = [i for i, t in enumerate(texts) if _rough(t)]
            whole = dict(zip(rough, self._library([texts[i] for i in rough])))
            head, tail, out = self.plain.__getitem__, self.spaced.__getitem__, []
            for i, t in enumerate(texts):
                if i in whole:
                    out.append(whole[i])
                    continue
                lines = []
                for x in t.split("\n"):
                    rest = iter(x.split(" "))
                    lines.append(head(next(rest)) + b"".join(map(tail, rest)))
                out.append(self.end_of_line.join(lines))
            return out
        return self._library(texts)


def encoder(path: str) -> ChunkEncoder:
    """This process's encoder of a tokenizer file; workers are reused, so the cache outlives a task."""
    if path not in _BY_PATH:
        _BY_PATH[path] = ChunkEncoder(path)
        hold("tokens", _BY_PATH.clear)
    return _BY_PATH[path]
