"""Byte-level BPE: batched numpy merge rounds, with a bounded cache of text pieces.

The vocabulary file is a parameter; nothing is trained and no file is copied.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

from .text import ragged

#: The split pattern of byte-level BPE vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space with white space on both sides does not always begin a pre-token.
_UNSAFE_SPACE = regex.compile(r"\s (?:\s|$)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stays, others move above U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, cache_entries: int = 300_000):
        spec = json.load(open(path, encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.size + right)
        self.pair_keys = (left * self.size + right)[order]
        self.pair_rank = order.astype(np.int64)
        self.rank_id = merged
        self.split = regex.compile(SPLIT)
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache_entries = cache_entries
        self._cache: dict[str, bytes] = {}
        self.decimal = [b"%d" % i for i in range(self.size)]

    # -- merging -----------------------------------------------------------

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words at once: all ids in word order, and the offsets of the words.

        All words lie in one flat array of symbols. In each round the rank of every
        adjacent pair is found by binary search, each word takes its lowest rank, and
        all its places of that rank merge from left to right. Finished words leave.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        none = len(self.rank_id)
        ranks = np.full(len(symbols), none, np.int32)
        ended: list[tuple[np.ndarray, np.ndarray]] = []

        def rank(at: np.ndarray) -> None:
            keys = symbols[at] * self.size + symbols[at + 1]
            found = np.minimum(np.searchsorted(self.pair_keys, keys), none - 1)
            ranks[at] = np.where(self.pair_keys[found] == keys, self.pair_rank[found], none)

        if len(symbols) > 1 and none:
            rank(np.flatnonzero(owner[:-1] == owner[1:]))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == none
            if done.any():
                live = np.repeat(~done, sizes)
                ended.append((owner[~live], symbols[~live]))
                symbols, owner, ranks = symbols[live], owner[live], ranks[live]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            gap = np.diff(at) != 1
            if not gap.all():  # a run of overlapping places (aaa): every second one merges
                first = np.maximum.accumulate(np.where(np.concatenate(([True], gap)), np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.rank_id[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # each earlier merge took one symbol out
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            ranks[new] = none
            touched = np.zeros(len(symbols) + 1, bool)
            touched[new] = touched[new - (new > 0)] = True
            touched = np.flatnonzero(touched[: len(symbols) - 1])
            same = owner[touched] == owner[touched + 1]
            ranks[touched[~same]] = none
            rank(touched[same])
        owners = np.concatenate([o for o, _ in ended]) if ended else np.zeros(0, np.int32)
        ids = np.concatenate([x for _, x in ended]) if ended else np.zeros(0, np.int64)
        offsets = ragged(np.bincount(owners, minlength=len(raw)))
        return ids[np.argsort(owners, kind="stable")].astype(self.dtype), offsets

    # -- texts -------------------------------------------------------------

    def sections(self, text: str) -> list[str]:
        """The text cut at special tokens; those stand at odd places."""
        if self._special is None or not any(s in text for s in self.special):
            return [text]
        return self._special.split(text)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of a text; joined they are the text."""
        parts = self.sections(text)
        return [t for k, p in enumerate(parts) for t in ([p] if k % 2 else self.split.findall(p))]

    def chunks(self, text: str) -> list[str]:
        """Text cut where pre-tokens surely begin: before single spaces. Joined they are the text."""
        if not text or _UNSAFE_SPACE.search(text):
            return self.split.findall(text)
        cut = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.split.findall(text)
        return cut if cut[0] else cut[1:]

    def _merge_into_cache(self, words: list[str]) -> None:
        width = self.dtype.itemsize
        for a in range(0, len(words), 100_000):
            part = words[a : a + 100_000]
            ids, offsets = self.merge_words(part)
            raw, at = ids.tobytes(), (offsets * width).tolist()
            self._cache.update(zip(part, map(raw.__getitem__, map(slice, at[:-1], at[1:])), strict=True))

    def _learn(self, missing: set[str]) -> None:
        """Put chunks that the cache lacks into it, and their pre-tokens; all new words merge together."""
        cache, find = self._cache, self.split.findall
        composed, words = {}, set()
        for c in missing:
            if c[0] == " " and c[1:].isalpha():
                words.add(c)
            else:
                ws = find(c)
                words.update(ws)
                if len(ws) > 1:
                    composed[c] = ws
        self._merge_into_cache([w for w in words if w not in cache])
        cache.update({c: b"".join([cache[w] for w in ws]) for c, ws in composed.items()})

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        get, missing = self._cache.get, set()
        cut: list[list] = []
        for text in texts:
            parts = []
            for k, p in enumerate(self.sections(text)):
                if k % 2:
                    parts.append((None, [np.array([self.special[p]], self.dtype).tobytes()]))
                    continue
                chunks = self.chunks(p)
                found = list(map(get, chunks))
                if None in found:
                    missing.update([c for c, x in zip(chunks, found, strict=True) if x is None])
                    parts.append((chunks, found))
                else:
                    parts.append((None, [b"".join(found)]))
            cut.append(parts)
        if missing:
            self._learn(missing)
        now = self._cache.__getitem__
        out = []
        for parts in cut:
            raw = [b"".join([now(c) if x is None else x for c, x in zip(chunks, found, strict=True)]) if chunks else found[0] for chunks, found in parts]
            out.append(np.frombuffer(b"".join(raw), self.dtype))
        if len(self._cache) > self.cache_entries:  # keep what the last texts used
            held = {c: now(c) for parts in cut for chunks, _ in parts if chunks for c in chunks if c in self._cache}
            self._cache.clear()
            self._cache.update(held)
        return out

    def count_words(self, words: list[str]) -> np.ndarray:
        """Number of ids of each pre-token; a special token counts one."""
        if len(self._cache) > self.cache_entries:
            self._cache.clear()
        held, width = self._cache, self.dtype.itemsize
        held.update({t: bytes(width) for t in self.special})  # only the length of an entry is looked at here, and texts are cut at special tokens
        self._merge_into_cache([w for w in set(words) if w not in held])
        return np.fromiter(map(len, map(held.__getitem__, words)), np.int64, len(words)) // width

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One codec for each Python worker and vocabulary file."""
    return ByteBpe(path)
