"""Tokenizer access for Python workers: files are a parameter, loaded once per worker, one thread each."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: The pre-tokenising pattern of byte-level BPE files that name ``ByteLevel`` with ``use_regex`` (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BORDER = re.compile(r"(?<=[!-~]) (?=[!-~])")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizers library's own object, without padding or truncation and on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the others for
    code points from 256 upwards in byte order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    table.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))})
    return table


class ByteBPE:
    """Byte-level BPE from a tokenizers JSON file: the ids the library gives, from a faster merge engine.

    The engine takes token ranks, so it is only used where ids rise in merge order, which is checked; texts that
    hold an added token's string, or that the engine refuses, go to the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.library = library_tokenizer(path)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        added_ids = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if v not in added_ids}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for t in spec.get("added_tokens", []):
            self.token_bytes[t["id"]] = t["content"].encode()
        self.decimal: list[str] = [str(i) for i in range(size)]
        self.engine = None
        pre = spec.get("pre_tokenizer") or {}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ids = [vocab[m] for m in merged]
        plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and not spec["model"].get("ignore_merges") and not spec["model"].get("dropout")
        )
        #: Whether words are parted by BYTE_LEVEL_PATTERN alone, so that they can be encoded apart.
        self.by_words = bool(plain)
        if plain and ids == sorted(ids):
            import tiktoken

            self.engine = tiktoken.Encoding(
                "byte_bpe", pat_str=BYTE_LEVEL_PATTERN, special_tokens={},
                mergeable_ranks={self.token_bytes[i]: i for i in vocab.values()},
            )

    def encode(self, text: str) -> list[int]:
        if self.engine is not None and not any(s in text for s in self.added):
            try:
                return self.engine.encode_ordinary(text)
            except (ValueError, RuntimeError, BaseExceptionGroup):  # the engine's regex gave up on this text
                pass
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_array(self, text: str, step: int = 1 << 20) -> np.ndarray:
        """``encode`` as unsigned 32-bit numbers. A text beyond ``step`` is encoded in parts that end before a
        space between two visible ASCII characters, where the pre-tokeniser always parts words."""
        parts, start = [], 0
        while len(text) - start > step and not any(s in text for s in self.added):
            cut = _BORDER.search(text, start + step)
            if cut is None:
                break
            parts.append(np.array(self.encode(text[start : cut.start()]), dtype=np.uint32))
            start = cut.start()
        parts.append(np.array(self.encode(text[start:] if start else text), dtype=np.uint32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: list[int]) -> str:
        """As the library with skip_special_tokens=False: token bytes joined, malformed UTF-8 replaced."""
        table = self.token_bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", errors="replace")

    def sentence_marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each id whether its token closes a sentence in any case, closes one if a blank follows, begins with a blank."""
        always, closing, blank = (np.zeros(len(self.token_bytes), dtype=bool) for _ in range(3))
        for i, b in enumerate(self.token_bytes):
            s = b.rstrip(b"\"')]")
            always[i] = b.endswith(b"\n") or b.endswith(("。".encode(), "！".encode(), "？".encode()))
            closing[i] = s.endswith((b".", b"!", b"?", "…".encode()))
            blank[i] = b[:1].isspace()
        return always, closing, blank


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
