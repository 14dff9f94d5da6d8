"""Vocabulary, merges and pre-split of a byte-level BPE tokenizer file.

The file is read once on the driver; its size is fixed by the vocabulary, so the tables are
shipped to the tasks inside a broadcast.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import regex

# Fixed value: the split of byte-level BPE, as the tokenizers library applies it.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Letters and numbers of Unicode versions after 16, which the tokenizers library does
# not know yet; it splits them like signs.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d
107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1
1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128
1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead
323b0-33479 3d000-3fc3f
"""


@dataclass
class BpeTables:
    """labels[id] = bytes; merges = (left id, right id, new id) by rank."""

    labels: list[bytes]
    byte_ids: list[int]
    merges: list[tuple[int, int, int]]
    special: dict[str, int]
    _splitters: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_splitters": None}

    def pieces(self, text: str) -> list:
        """Pre-tokens as str and special tokens as int ids, in the order of the text."""
        if self._splitters is None:
            special = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
            newer = "".join(
                "-".join(f"\\U{int(end, 16):08x}" for end in span.split("-")) for span in NEWER.split()
            )
            exact = PRE_SPLIT.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[NEW])")
            exact = exact.replace(r"\p{L}+", r"(?:(?![NEW])\p{L})+").replace(r"\p{N}+", r"(?:(?![NEW])\p{N})+")
            self._splitters = (
                regex.compile(PRE_SPLIT),
                regex.compile(exact.replace("NEW", newer)),
                re.compile(f"[{newer}]"),
                regex.compile(f"({special})") if special else None,
            )
        split, exact, newer, marks = self._splitters
        if not _latin(text) and newer.search(text):
            split = exact
        if marks is None or not any(mark in text for mark in self.special):
            return split.findall(text)
        found: list = []
        for k, part in enumerate(marks.split(text)):
            if k % 2:
                found.append(self.special[part])
            elif part:
                found.extend(split.findall(part))
        return found


def _latin(text: str) -> bool:
    """No character beyond Latin-1, so none of the newer ones."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_alphabet() -> dict[str, int]:
    """Character of each byte: visible Latin-1 stands for itself, the rest counts up from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_tables(path: str) -> BpeTables:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = (
        model["type"] == "BPE"
        and split == split | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        and not any(spec[k] for k in ("normalizer", "post_processor"))
        and not any(
            model.get(k)
            for k in ("dropout", "unk_token", "continuing_subword_prefix",
                      "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        raise ValueError(f"{path}: only plain byte-level BPE files are supported")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    labels = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, at in vocab.items():
        labels[at] = bytes(alphabet[c] for c in token)
    for token, at in special.items():
        labels[at] = token.encode()
    byte_ids = [0] * 256
    for char, byte in alphabet.items():
        byte_ids[byte] = vocab[char]
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return BpeTables(labels, byte_ids, merges, special)
