"""Texts as sequences of context-free chunks, so that a tokenizer sees each distinct chunk once.

A space before a character that isn't white space always begins a new piece of the byte-level pattern,
and the word-level one drops white space, so a text may be cut before each such space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r" (?=\S)")


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _blank_or_after_space(texts: pa.Array) -> np.ndarray:
    """Whether a text is empty or begins with white space, as Python knows it."""
    first = pc.utf8_slice_codeunits(texts, 0, 1).dictionary_encode()
    return np.array([not x or x.isspace() for x in first.dictionary.to_pylist()], dtype=bool)[first.indices.to_numpy(zero_copy_only=False)]


class Chunked:
    """``numbers[offsets[i]:offsets[i + 1]]``: text i as numbers of ``words``, an Arrow array of chunks.

    A text that holds one of the strings ``special`` is a single chunk: a tokenizer ends a section of the
    text there, so what stands before it isn't free of context.
    """

    def __init__(self, texts: pa.Array, special: Sequence[str] = ()) -> None:
        texts = pa.array(texts, pa.large_string()).fill_null("") if not isinstance(texts, pa.Array) else texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        later = coded.dictionary
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets -= offsets[0]
        rows_of = lambda places: np.unique(np.searchsorted(offsets, places, side="right") - 1)
        whole = np.zeros(len(texts), dtype=bool)
        for mark in special:
            if " " in mark:
                whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
            else:  # it lies inside one piece
                has = pc.match_substring(later, mark).to_numpy(zero_copy_only=False)
                if has.any():
                    whole[rows_of(np.flatnonzero(has[numbers]))] = True
        heads = numbers[offsets[:-1]]
        odd = _blank_or_after_space(later)
        odd_at = odd[numbers] if odd.any() else np.zeros(len(numbers), dtype=bool)
        odd_at[offsets[:-1]] = False
        first = dict.fromkeys(heads.tolist())
        text = lambda x: pa.scalar(x, pa.large_string())
        self.words = pa.concat_arrays([pc.binary_join_element_wise(text(""), later, text(" ")), later.take(pa.array(list(first), pa.int64()))])
        place = {k: len(later) + i for i, k in enumerate(first)}
        numbers[offsets[:-1]] = [place[k] for k in heads.tolist()]
        self.numbers, self.offsets = numbers, offsets
        if odd_at.any() or whole.any():
            self._split_again(texts, np.union1d(rows_of(np.flatnonzero(odd_at)), np.flatnonzero(whole)).astype(np.int64), whole)

    @property
    def chunks(self) -> list[str]:
        """``words`` as a list."""
        return _strings(self.words)

    def _split_again(self, texts: pa.Array, rows: np.ndarray, whole: np.ndarray) -> None:
        """Texts with white space next to a space are cut by the slower rule, ``whole`` ones not at all."""
        chunks = self.chunks
        known = {c: i for i, c in enumerate(chunks)}
        parts, redo = [], set(rows.tolist())
        for i in range(len(texts)):
            if i in redo:
                own = [texts[i].as_py()] if whole[i] else _CUT.split(texts[i].as_py())
                own = own[:1] + [" " + x for x in own[1:]]
                parts.append(np.array([known.setdefault(x, len(known)) for x in own], dtype=np.int64))
            else:
                parts.append(self.numbers[self.offsets[i] : self.offsets[i + 1]])
        self.words = pa.array(list(known) if len(known) == len(chunks) else chunks + list(known)[len(set(chunks)) :], pa.large_string())
        self.numbers = np.concatenate(parts)
        self.offsets = np.cumsum([0, *map(len, parts)])


def gather(values: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[k]:starts[k + 1]]`` for each k of ``numbers``, joined, and each run's length."""
    lengths = np.diff(starts)[numbers]
    total = int(lengths.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((starts[:-1][numbers] - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at], lengths


#: A chunk that is one run of letters, of ranges whose class and lower case are the same in every version
#: of Unicode, and perhaps one mark, and perhaps such a word on the next line: the pieces of either
#: pattern are those runs, those marks and the line feed.
_LETTERS, _MARK = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+", "[.,;:!?]?"
_PLAIN = re.compile(f"( ?{_LETTERS})({_MARK})(?:(\n)({_LETTERS})({_MARK}))?")
#: For Arrow: a chunk that is letters, and one whose pieces are letters, a run of ASCII marks but the apostrophe, a line feed, letters and marks again.
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_WORD, _PIECES = f"^ ?{_LETTERS}$", f"^(?P<word> ?{_LETTERS})(?P<marks>{_MARKS})(?P<line>\n?)(?P<next>(?:{_LETTERS})?)(?P<last>{_MARKS})$"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def special_strings(tokenizer_file: str) -> list[str]:
    """The strings in a text that the tokenizer takes for its added tokens."""
    with open(tokenizer_file, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def encoder(tokenizer_file: str, word_level: bool = False) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """A function from an Arrow array of chunks to their ids, one after the other, and where each chunk's begin.

    The library's whole chain of added tokens, normaliser, pattern and model runs on every chunk but plain
    words, whose pieces go to its model directly, each distinct one once: lower-cased and without their space at ``word_level``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()
    fixed = {"": [], "\n": tokenizer.encode("\n", add_special_tokens=False).ids}

    def word(piece: str) -> list[int]:
        if piece in fixed:
            return fixed[piece]
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(letters)
        elif piece[0] == " ":  # of ASCII, only the space has another letter
            piece = letters[32] + piece[1:]
        return [t.id for t in tokenize(piece)]

    def encode(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        free = np.ones(len(chunks), dtype=bool)
        for mark in special:
            free &= ~pc.match_substring(chunks, mark).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(chunks, _WORD).to_numpy(zero_copy_only=False) & free
        rest = np.flatnonzero(~plain)
        parts = pc.extract_regex(chunks.take(pa.array(rest)), _PIECES)
        fits = parts.is_valid().to_numpy(zero_copy_only=False) & free[rest]
        # every distinct piece once; a row for each chunk, with the numbers of its pieces
        pieces = pa.concat_arrays([chunks.filter(pa.array(plain)), *parts.filter(pa.array(fits)).flatten()])
        if word_level:
            pieces = pc.utf8_lower(pc.utf8_ltrim(pieces, " "))
        coded = pieces.dictionary_encode()
        found = list(map(word, _strings(coded.dictionary)))
        numbers, n_plain = coded.indices.to_numpy(zero_copy_only=False), int(plain.sum())
        table = np.full((len(chunks), 5), -1, dtype=np.int32)
        table[plain, 0] = numbers[:n_plain]
        table[rest[fits]] = numbers[n_plain:].reshape(5, -1).T
        other = rest[~fits]
        table[other, 0] = len(found) + np.arange(len(other))
        texts = _strings(chunks.take(pa.array(other)))
        for k in range(0, len(texts), 4096):
            found += [e.ids for e in tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))))
        flat = np.fromiter(chain.from_iterable(found), np.int32, starts[-1])
        held = table >= 0
        ids, lengths = gather(flat, starts, table[held])
        upto = np.concatenate(([0], np.cumsum(lengths)))
        return ids, upto[np.concatenate(([0], np.cumsum(held.sum(axis=1))))]

    return encode


def text_slices(texts: pa.Array, most_bytes: int) -> Iterator[slice]:
    """Slices of about ``most_bytes`` at most; one longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most_bytes:
            yield slice(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def encoded_texts(texts: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], special: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, one after the other, and each text's offset."""
    chunked = Chunked(texts, special)
    values, starts = encode(chunked.words)
    ids, lengths = gather(values, starts, chunked.numbers)
    return ids, np.concatenate(([0], np.cumsum(lengths)))[chunked.offsets]
