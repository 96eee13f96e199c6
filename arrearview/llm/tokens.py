"""Token ids of whole texts, as the `tokenizers` library gives them for a byte-level BPE file.

A byte-level BPE encodes every pre-token by itself, by the rank of its merges. Where the file's merges stand in the
order of their ids, tiktoken's encoder over the same vocabulary makes the same ids several times faster, so it takes
all ordinary texts. Texts with a special string, or with characters outside long-settled Unicode blocks where the
pattern's character classes could differ between libraries, go through `tokenizers` itself.
"""

from __future__ import annotations

import json
from array import array

import regex

#: The pre-token pattern of the byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: ASCII without the separators 1C-1F, Latin, basic Greek and Cyrillic, general punctuation, common CJK and kana.
SETTLED = regex.compile("[\t-\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-⁞"
                        "ぁ-ゖァ-ヺ一-龥]*")


def byte_names() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and numbers the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.pretokens = regex.compile(PATTERN).findall
        self.fast = self._by_rank(path, special)

    @staticmethod
    def _by_rank(path: str, special: dict[str, int]):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind, model, names = made.get("pre_tokenizer") or {}, made["model"], byte_names()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"].get("".join(p)) for p in pairs]
        if (kind.get("type"), kind.get("use_regex"), kind.get("add_prefix_space")) != ("ByteLevel", True, False) \
                or made.get("normalizer") or None in order or order != sorted(order):
            return None
        ranks = {bytes(names[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ordinary(self, text: str) -> bool:
        return bool(self.fast and SETTLED.fullmatch(text) and not self.special.search(text))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        ids = array("I", self.fast.encode_ordinary(text) if self.ordinary(text) else self.whole(text))
        return ids.tobytes()

    def piece_length(self, pretoken: str) -> int:
        """Tokens of one pre-token of an ordinary text."""
        return len(self.fast.encode_ordinary(pretoken))
