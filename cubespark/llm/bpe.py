"""Byte-level BPE: exact merges in linear time from longest matches, and decoding."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import cached_property, lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kept, safe_pieces, spread

#: Entries in each of a worker's two generations of encoded pieces; others have less.
MEMO = 250_000
#: Blanks (fixed values: the characters of Unicode's White_Space property).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Blanks and what follows them up to the next blank: no match of a pattern whose tokens have blanks in front
#: only reaches over the end of such a word.
WORDS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Characters that are split at a time.
PIECE = 1 << 18
#: Characters that a search for longest matches copies; more than twice a vocabulary's longest token.
WINDOW = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Memo(dict):
    """A function's results; the older half goes when the newer is full."""

    def __init__(self, function, limit: int = MEMO):
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        if (found := self.old.pop(key, None)) is None:
            found = self.function(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class BytePairs:
    """Encoder and decoder for the ranks of a vocabulary in which lower ranks merge first and bytes come first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.fits = Memo(lambda x: self._fits((x >> 32, x & 0xFFFFFFFF)), 2 * MEMO)
        trie = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
            elif (pair := self._halve(token, rank)) is not None:
                self.halves[rank] = pair
                self.merged[pair] = rank
            else:
                continue  # merges never make it; only a piece that it fills is it
            trie.add_word(token.decode("latin-1"), (rank, len(token)))
        trie.make_automaton()
        self.trie = trie
        self.reach = max(map(len, ranks))
        self.window = max(WINDOW, 2 * self.reach)
        self.fits.clear()
        self.shorter = Memo(self._shorter)
        self.pieces = Memo(self._piece)
        self.words = Memo(self._word, MEMO // 10)
        self.pattern = pattern
        self.split_latin = re.compile(latin_pattern(pattern)).findall

    @cached_property
    def split(self) -> Callable[[str], list[str]]:
        """Matches of the pattern in any text; made when a text has other characters than Latin-1's."""
        return regex.compile(exact_pattern(self.pattern)).findall

    def _halve(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge of ``token``: the one split into lower ranks that no other merge crosses."""
        for i in range(len(token) - 1, 0, -1):
            a, b = self.ranks.get(token[:i], rank), self.ranks.get(token[i:], rank)
            if a < rank and b < rank and a in self.halves and b in self.halves and self._fits((a, b)):  # not memoised: merges are still being added
                return a, b
        return None

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether the two tokens can stand side by side: undoing the latest merges on either side of the border,
        one by one, never shows a pair that would have merged across it sooner."""
        a, b = pair
        limit = len(self.ranks) + (1 << 30)
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            left, right = self.halves[a], self.halves[b]
            # of two merges the later (on a tie the right one, made second) is undone
            if a > b and left[0] != a or right[0] == b:
                if left[0] == a:
                    return True
                limit, a = a, left[1]
            else:
                limit, b = b + 1, right[0]

    def _shorter(self, rank: int) -> int:
        """The longest token that is a proper prefix of the token; -1 for a byte."""
        token = self.tokens[rank]
        for i in range(len(token) - 1, 0, -1):
            if (found := self.ranks.get(token[:i], -1)) in self.halves:
                return found
        return -1

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern. Each place is given up at most once, so the time is linear in its length."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        chars, longest = piece.decode("latin-1"), self.trie.iter_long
        fits, tokens, shorter, window = self.fits, self.tokens, self.shorter, self.window
        safe = window - self.reach  # a match that starts later may be cut by the window's end
        ids: list[int] = []
        dead = bytearray(len(piece) + 1)
        # every byte is a token: each match starts where the last one ended, so one search serves until a token gives way
        at = base = 0
        direct = True
        found = longest(chars[:window])
        token, length = next(found)[1]
        while True:
            end = at + length
            if not dead[end] and (not ids or fits[ids[-1] << 32 | token]):
                ids.append(token)
                if end == len(piece):
                    return ids
                if not direct or end - base > safe:
                    base, direct = end, True
                    found = longest(chars[end : end + window])
                at = end
                token, length = next(found)[1]
            elif (less := shorter[token]) >= 0:
                token, length, direct = less, len(tokens[less]), False
            else:  # nothing can start here: the last token gives way to a shorter one
                dead[at] = 1
                token = ids.pop()
                length = len(tokens[token])
                at -= length
                direct = False

    def _piece(self, piece: str) -> bytes:
        return b"".join([self.packed[x] for x in self.encode_piece(piece.encode())])

    def _word(self, word: str) -> bytes:
        found = self.split(word)
        return self.pieces[word] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._part, safe_pieces(text, PIECE)))

    def _part(self, part: str) -> bytes:
        if is_latin(part):
            return b"".join(map(self.pieces.__getitem__, self.split_latin(part)))
        return b"".join(map(self.words.__getitem__, WORDS.findall(part)))

    def decode(self, ids: bytes) -> bytes:
        get = self.tokens.__getitem__
        view = memoryview(ids)
        return b"".join([b"".join(map(get, view[i : i + 4 * PIECE].cast("I"))) for i in range(0, len(ids), 4 * PIECE)])


def is_latin(text: str) -> bool:
    """Whether all characters are Latin-1's; the codec tells sooner than a look at each of them."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def latin_pattern(pattern: str) -> str:
    """``pattern`` for texts of characters up to U+00FF, whose classes no Unicode version changes, spelled out for re."""
    letter, digit, space = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\S", f"[^{space}]")
    return pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]").replace(r"\s", f"[{space}]")


def _ranges(chars: set[str]) -> str:
    """``chars`` as the inside of a class."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=4)
def exact_pattern(pattern: str) -> str:
    """``pattern`` with its classes as tiktoken's engine knows them: the two libraries' Unicode versions differ.

    An encoding whose pattern is the class alone drops all other characters, which shows the class.
    """
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=single, special_tokens={})
        extra, missing = set(), set()
        for start in range(0, 0x110000, 0x800):
            some = "".join(map(chr, range(start, start + 0x800))) if not 0xD800 <= start < 0xE000 else ""
            theirs, ours = set(bytes(probe.encode_ordinary(some)).decode()), set(regex.findall(name, some))
            extra |= ours - theirs
            missing |= theirs - ours
        out[name] = (_ranges(extra), _ranges(missing))
    inside = {n: f"{n}{missing}" for n, (_, missing) in out.items()}
    if not any(a or b for a, b in out.values()):
        return pattern
    letter, digit, space = (f"[{inside[n]}--[{out[n][0]}]]" if out[n][0] else f"[{inside[n]}]" for n in out)
    other = f"[^{letter}{digit}{space}]"
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "\0").replace(r"\S", "\1")
    for name, kind in zip(out, (letter, digit, space), strict=True):
        pattern = pattern.replace(name, kind)
    return "(?V1)" + pattern.replace("\0", other).replace("\1", f"[^{space}]")


def coder(path: str, pattern: str) -> BytePairs:
    """One for each Python worker."""
    return kept(("bpe", path, pattern), lambda: BytePairs(read_ranks(path), pattern))


def _encoded(texts: pa.Array, one: BytePairs) -> pa.Array:
    return pa.array((one.encode(x.decode("utf-8", "replace")) for x in as_bytes(texts)), pa.binary(), size=len(texts))


def _decoded(codes: pa.Array, one: BytePairs) -> pa.Array:
    return pa.array((one.decode(x) for x in as_bytes(codes)), pa.binary(), size=len(codes))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: the ids of the whole ``text`` as little-endian unsigned 32-bit integers (binary).

    Each match of ``pattern`` is encoded by itself, by the ranks in the file at ``path`` (on each executor), without
    special tokens. Null counts as empty: no ids. Long texts are split in parts at places where no match reaches
    over. Equal texts get equal ids; an empty table gives an empty table; a column named ``out`` is replaced.
    """
    encoded = F.arrow_udf(lambda texts: _encoded(texts, coder(path, pattern)), "binary")
    return spread(df).withColumn(out, encoded(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that ``ids`` stand for. Null ids count as none; an unknown id is an error."""
    decoded = F.arrow_udf(lambda codes: _decoded(codes, coder(path, pattern)), "binary")
    return df.withColumn(out, decoded(F.col(ids)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "coded") -> DataFrame:
    """``df`` with ``out``: (ids, decoded), as ``encode`` and then ``decode`` give them.

    Spark runs ``decode`` over ``encode`` in one Python node and computes the ids twice there, once as a column and once
    as what is decoded; here each text is encoded once.
    """

    def both(texts: pa.Array) -> pa.Array:
        one = coder(path, pattern)
        ids = _encoded(texts, one)
        return pa.StructArray.from_arrays([ids, _decoded(ids, one)], ["ids", "decoded"])

    return spread(df).withColumn(out, F.arrow_udf(both, "ids binary, decoded binary")(F.col(text)))
