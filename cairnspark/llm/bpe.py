"""Byte-level BPE read from a ``tokenizers`` file, with the same ids as that library gives."""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np

#: Fixed value: the pre-token pattern of byte-level BPE, with possessive repeats that change no match.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_of() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def describe(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def is_byte_level(path: str) -> bool:
    """Whether the file is plain byte-level BPE, whose pre-tokens are encoded one by one."""
    if not path.endswith(".json"):
        return False
    d = describe(path)
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    ranks = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(a >= b for a, b in zip([-1, *ranks], ranks)):  # an id has to be the rank of its merge
        return False
    return d.get("normalizer") is None and d.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"])


def special_tokens(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in describe(path)["added_tokens"]}


@lru_cache(4)
def library(path: str):
    """The tokenizer itself, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(4)
def fast(path: str):
    """An encoder over the file's own vocabulary: in byte-level BPE the id of a piece is its merge rank."""
    import tiktoken

    at, special = byte_of(), special_tokens(path)
    ranks = {bytes(at[c] for c in piece): i for piece, i in describe(path)["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)


LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
BESIDE = {LETTER: "a", NUMBER: "1", OTHER: "!"}
#: What makes a pre-token with an apostrophe before it.
AFTER_APOSTROPHE = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(4)
def classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point as the file's own pre-tokenizer has it: first code points of stretches, classes.

    Versions of Unicode differ between libraries, so Python's categories are only a guess: a stretch of one category
    behind a character of its class must be one pre-token, and where it isn't it is halved.
    """
    cut = library(path).pre_tokenizer.pre_tokenize_str
    guess = {"L": LETTER, "N": NUMBER}
    first, kinds = [], []

    def put(at: int, kind: int) -> None:
        if not kinds or kinds[-1] != kind:
            first.append(at)
            kinds.append(kind)

    def settle(low: int, high: int, kind: int) -> None:
        text = "".join(map(chr, range(low, high)))
        if kind in BESIDE and len(cut(BESIDE[kind] + text)) == 1:
            put(low, kind)
        elif high - low > 1:
            settle(low, (low + high) // 2, kind)
            settle((low + high) // 2, high, kind)
        else:
            put(low, next((k for k, c in BESIDE.items() if len(cut(c + text)) == 1), SPACE))

    kind_of = lambda c: OTHER if 0xD800 <= c < 0xE000 else SPACE if chr(c).isspace() else guess.get(unicodedata.category(chr(c))[0], OTHER)
    low = 0
    while low < 0x110000:
        kind, high = kind_of(low), low + 1
        while high < 0x110000 and high - low < 4096 and high not in (0xD800, 0xE000) and kind_of(high) == kind:
            high += 1
        if 0xD800 <= low < 0xE000:
            put(low, OTHER)  # surrogates stand in no text
        else:
            settle(low, high, kind)
        low = high
    return np.array(first, np.int64), np.array(kinds, np.uint8)


class PreTokens:
    """Byte-level pre-tokens of many texts at once, by the classes of their characters."""

    def __init__(self, first: np.ndarray, kinds: np.ndarray):
        self.kind = np.repeat(kinds, np.diff(np.r_[first, 0x110000]))

    def of(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text, in order.

        Characters of one class stay together, and so does a blank with what follows it; of other white space before
        a word the last character stands alone; an apostrophe that begins a pre-token takes its ending along.
        """
        whole = "\0" + "".join(t + "\0" for t in texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.cumsum([0] + [len(t) + 1 for t in texts])
        kind = self.kind[code]
        kind[edge] = EDGE
        begin = np.ones(len(code), bool)
        begin[1:] = kind[1:] != kind[:-1]
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & (kind[1:] < SPACE))  # before a word
        begin[last] = True
        begin[last[code[last] == 32] + 1] = False
        quote = np.flatnonzero((code == 39) & begin)
        for ending in AFTER_APOSTROPHE:
            at = quote
            for k, c in enumerate(ending, 1):
                at = at[code[np.minimum(at + k, len(code) - 1)] == ord(c)]
            begin[at + 1] = False
            begin[at + len(ending)] = False
            begin[at + len(ending) + 1] = True
        begin[edge] = True
        spot = np.flatnonzero(begin)
        bounds, cuts = spot.tolist(), np.searchsorted(spot, edge).tolist()
        return [[whole[a:b] for a, b in zip(bounds[i + 1 : j], bounds[i + 2 : j + 1])] for i, j in zip(cuts, cuts[1:])]
