"""Token ids of whole texts, by words.

The tokenizer's pre-tokenizer drops white space, so no token spans it and the
ids of a text are the ids of its words, one after the other.  Arrow splits the
texts of a group and numbers its different words; each Python worker keeps the
ids of the words it has met in a table of bounded size, and encodes the words
a group adds to it in one call.

Words of Latin letters, digits and signs go through tiktoken with the same
vocabulary: a byte 0 stands for the end-of-word mark, and an id is also its
merge's rank.  All other words go through the tokenizer itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of each of the two generations of a worker's table.
WORDS_KEPT = 300_000
#: Words whose ids are put together at a time.
LOOKED_UP = 1 << 18
#: Bytes of text in a group of ``text_groups``.
GROUP_BYTES = 8_000_000
#: The pre-tokenizer's pattern, as the vocabulary file states it (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Kinds of characters; one of kind 0 leaves its word to the tokenizer.
_LETTER, _DIGIT, _SIGN, _LINE = 1, 2, 3, 4
_APOSTROPHE, _LESS, _BAR = map(ord, "'<|")

_tables: dict[str, "WordIds"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _printable_bytes() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}


def _latin_kinds() -> np.ndarray:
    """Kind by code: printable ASCII and Latin-1 without white space; the last entry stands for all codes beyond."""
    kinds = np.zeros(257, dtype=np.uint8)
    for c in (*range(0x21, 0x7F), *range(0xA1, 0x100)):
        kinds[c] = _LETTER if regex.match(r"\p{L}", chr(c)) else _DIGIT if regex.match(r"\p{N}", chr(c)) else _SIGN
    kinds[ord("\n")] = _LINE
    return kinds


_KINDS = _latin_kinds()
_LOWER = np.array([ord(chr(c).lower()) for c in range(256)], dtype=np.uint8)


def _piece_ends(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a piece of the pre-tokenizer's pattern ends at each of the lower-cased ``codes``; lines end pieces."""
    ends = np.ones(len(codes), dtype=bool)
    ends[:-1] = (kinds[1:] != kinds[:-1]) | (kinds[:-1] == _DIGIT)
    at = np.flatnonzero(codes == _APOSTROPHE)
    at = at[(at == 0) | (kinds[at - 1] != _SIGN)]  # inside a run of signs it is one of them
    one, two = (np.append(codes, [0, 0])[at + k] for k in (1, 2))
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])
    ends[at[short | long]] = False
    ends[at[short] + 1] = True
    ends[at[long] + 2] = True
    return ends


def _listed(words: pa.Array) -> list[bytes]:
    """``words``, which hold no line breaks; far quicker than ``to_pylist``."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")[0].as_py().split(b"\n") if len(words) else []


class _Table:
    """Words and their ids, which lie one word's after the other's."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.ends, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")

    def add(self, words: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        first = len(self.rows)
        self.rows.update(zip(words, range(first, first + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids, of the words in ``rows``."""
        first = self.ends[rows]
        lengths = self.ends[rows + 1] - first
        before = np.cumsum(lengths) - lengths
        return lengths, self.ids[np.repeat(first - before, lengths) + np.arange(lengths.sum())]


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._fast, self._new, self._old = None, _Table(), _Table()
        spec = json.loads(self._tokenizer.to_str())
        if spec["model"].get("end_of_word_suffix") == "</w>" and PIECES in str(spec["pre_tokenizer"]).replace("\\\\", "\\").replace("\\'", "'"):
            import tiktoken

            of = _printable_bytes()
            ranks = {}
            for token, k in spec["model"]["vocab"].items():
                mark = token.endswith("</w>")
                body = token[:-4] if mark else token
                if all(c in of for c in body) and token not in ("<|startoftext|>", "<|endoftext|>"):
                    ranks[bytes(of[c] for c in body) + b"\0" * mark] = k
            top = max(ranks.values()) + 1
            # No text holds the special token; without any the encoder would look for one at each byte.
            self._fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={"\0\0": top})
            self._last = np.zeros(top, dtype=bool)
            self._last[[k for token, k in ranks.items() if token.endswith(b"\0")]] = True

    def _add(self, words: list[bytes]) -> None:
        if self._fast:
            words = [w for _, some in in_groups(words) for w in self._add_latin(some)]
        if words:
            ids = [np.array(self._tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4") for w in words]
            self._new.add(words, [len(x) for x in ids], np.concatenate(ids))

    def _add_latin(self, words: list[bytes]) -> list[bytes]:
        """Add the words that go through tiktoken; the others are returned."""
        codes = np.frombuffer((b"\n".join(words) + b"\n").decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        kinds = _KINDS[np.minimum(codes, 256)]
        lines = kinds == _LINE
        word = np.cumsum(lines, dtype=np.int32) - lines
        # Latin letters are their own composed form and have one lower case; special tokens start with "<|".
        other = np.zeros(len(words), dtype=bool)
        other[word[kinds == 0]] = True
        other[word[:-1][(codes[:-1] == _LESS) & (codes[1:] == _BAR)]] = True
        if other.any():
            kept = ~other[word]
            codes, kinds, word = codes[kept], kinds[kept], word[kept]
        codes = _LOWER[codes]
        ends = _piece_ends(codes, kinds)
        text = kinds != _LINE
        codes, ends, word = codes[text], ends[text], word[text]
        marked = np.stack([codes, np.zeros_like(codes)], axis=1)[np.stack([np.ones_like(ends), ends], axis=1)]
        ids = self._fast.encode_to_numpy(marked.tobytes().decode("latin-1"), disallowed_special=())
        upto = np.append(0, np.flatnonzero(self._last[ids]) + 1)  # ids up to the end of each piece
        pieces = np.bincount(word[ends], minlength=len(words))
        lengths = np.diff(upto[np.append(0, np.cumsum(pieces))])
        self._new.add([w for w, o in zip(words, other.tolist(), strict=True) if not o], lengths[~other], ids)
        return [words[k] for k in np.flatnonzero(other)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the places where each begins and the last ends; null: none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string()))
        numbered = split.flatten().dictionary_encode()
        rows = self._rows(_listed(numbered.dictionary.view(pa.binary())))
        places = numbered.indices.to_numpy()
        found = [self._new.of(rows[places[k : k + LOOKED_UP]]) for k in range(0, len(places), LOOKED_UP)]
        ends = np.concatenate([[0], *(n for n, _ in found)], dtype=np.int64).cumsum()
        return np.concatenate([np.zeros(0, dtype="<u4"), *(x for _, x in found)]), ends[split.offsets.to_numpy()]

    def _rows(self, words: list[bytes]) -> np.ndarray:
        """Rows of different words in the table, to which new ones are added."""
        rows = list(map(self._new.rows.get, words))
        unknown = [w for w, r in zip(words, rows, strict=True) if r is None]
        if len(self._new.rows) + len(unknown) > WORDS_KEPT:  # words that are met again come back from the old generation
            self._old, self._new = self._new, _Table()
            rows, unknown = [None] * len(words), words
        old = list(map(self._old.rows.get, unknown))
        back = [w for w, r in zip(unknown, old, strict=True) if r is not None]
        if back:
            self._new.add(back, *self._old.of(np.array([r for r in old if r is not None])))
        if len(back) < len(unknown):
            self._add([w for w, r in zip(unknown, old, strict=True) if r is None])
        get = self._new.rows
        return np.array([get[w] if r is None else r for w, r in zip(words, rows, strict=True)], dtype=np.int64)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text, packed; null: none."""
        ids, at = self.encode_all(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


def text_groups(batches: Iterator[pa.RecordBatch], column: int, most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            n += 64  # rows without text count, too
            if size and size + n > most:
                held.append(batch.slice(start, k - start))
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, start = [], 0, k
            size += n
        held.append(batch.slice(start))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def in_groups(values: list[bytes | None], most: int = 4_000_000):
    """Slices of ``values`` of about ``most`` bytes; a longer value stands alone."""
    start = size = 0
    for k, v in enumerate(values):
        if k > start and size + len(v or b"") > most:
            yield start, values[start:k]
            start, size = k, 0
        size += len(v or b"")
    if start < len(values):
        yield start, values[start:]
