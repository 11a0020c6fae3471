"""Token ids of texts by a byte-level BPE vocabulary file of the library `tokenizers`.

Most texts take a faster way to the same ids: tiktoken with the same vocabulary, used only where the file is a plain byte-level BPE whose
ids are in the order of its merges, and only for texts of printable ASCII and Latin letters without special strings. All
other texts go through `tokenizers`. Long texts are encoded window by window, cut at a space between two letters or digits, which no
token spans.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

WINDOW = 1 << 18
# Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-ſ]")
_SAFE = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or for the others the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (gap := _SAFE.search(text, at + size)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class Encoder:
    """`source` is the content of the vocabulary file, so that it can be sent to workers that do not have the file."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(source)
        self.fast = self._fast(json.loads(source))

    @staticmethod
    def _fast(file: dict):
        model, before = file["model"], file.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        vocabulary, letters = model.get("vocab", {}), _letters()
        plain = model.get("type") in ("BPE", None) and not model.get("dropout") and not model.get("ignore_merges") and file.get("normalizer") is None
        plain = plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in word): n for word, n in vocabulary.items() if n < 256 + len(merges)}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null and empty texts."""
        found: list[np.ndarray] = []
        for text in texts:
            parts = []
            for part in windows(text or ""):
                parts.append(np.array(self._fast_ids(part) or self.exact.encode(part, add_special_tokens=False).ids, np.uint32))
            found.append(np.concatenate(parts))
        return found

    def _fast_ids(self, text: str) -> list[int] | None:
        if self.fast is None or "<|" in text or _ODD.search(text):
            return None
        try:
            return self.fast.encode_ordinary(text)
        except ValueError:  # its pattern engine gives up on endless white space
            return None
