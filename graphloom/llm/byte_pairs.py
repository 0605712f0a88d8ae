"""Byte-level BPE: the ids of the tokenizers library, made by tiktoken with the vocabulary's ids as merge ranks.

The vocabulary is read from its tokenizer file, which must be plain: no normaliser, the published pattern, merges in the
order of their ids. Others are refused. Nothing is remembered between texts, so a worker does not grow with the words
that it meets.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The pre-tokens of byte-level BPE (fixed value of the tokenizer's published pattern).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte-level BPE's alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
#: Runs of Unicode's white space from so many characters on are cut out: the pattern's look-ahead takes stack by their length.
LONG = 10_000
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]" + f"{{{LONG},}}")


class BytePairs:
    """The vocabulary of a tokenizer file: ids of whole texts, and `names`, the written form of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            entries = json.load(f)
        model, pre, added = entries["model"], entries["pre_tokenizer"] or {}, entries["added_tokens"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        odd += [entries.get(k) for k in ("normalizer", "truncation", "padding")] + [x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")]
        if any(odd) or model.get("type", "BPE") != "BPE" or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        ids = model["vocab"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        if any(ids[m] - ids[merges[0]] != k for k, m in enumerate(merges)):
            raise ValueError(f"the merges of {path} are not in the order of their ids")
        self.special = {x["content"]: x["id"] for x in added}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in ids.items() if t not in self.special}
        self.coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text in which strings of special tokens are plain text."""
        if len(text) < LONG or not _LONG_SPACE.search(text):
            return np.array(self.coder.encode_ordinary(text), "<u4")
        found, at = [], 0
        for m in _LONG_SPACE.finditer(text):
            # Only the last space of a run belongs to what follows it; the run's rest, or a run at the end, is one pre-token.
            end = m.end() - (m.end() < len(text))
            found += [*self.coder.encode_ordinary(text[at : m.start()]), *self.coder._encode_single_piece(text[m.start() : end])]
            at = end
        return np.array(found + self.coder.encode_ordinary(text[at:]), "<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text in which strings of special tokens are these tokens."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = [[self.special[p]] if p in self.special else self.plain(p) for p in self.split.split(text) if p]
        return np.concatenate(parts).astype("<u4")
