"""Token ids of whole Arrow text columns, computed once per distinct word of a task.

The tokenizers used here never join characters across the start of a white-space run, nor an ASCII letter with
a following ASCII sign or digit, so a text is cut there, distinct pieces are encoded once, and the ids of the
texts are gathered with array operations.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from firmlens.llm.shingles import text_buffer

#: Distinct pieces, and characters of them, remembered by a task; beyond either the memory starts anew.
REMEMBERED = 1 << 19
REMEMBERED_CHARS = 16 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Last bytes of Unicode spaces, and control characters that some patterns take for spaces: no cut after these.
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII signs and digits; the bar is left out, because special tokens hold a letter before it.
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalpha() and chr(b) != "|"]] = True


#: What a byte is, as bits: 1 no space and not unsure, 2 and 32 space, 4 ASCII letter, 8 sign, 16 unsure and not ASCII.
_KINDS = (
    np.where(_SPACE, 34, 1) - np.where(_UNSURE, 1, 0) + 4 * _LETTER + 8 * _SIGN + 16 * (_UNSURE & (np.arange(256) >= 0x80))
).astype(np.uint8).tobytes()
#: Bytes before the last one of a Unicode space; after any other, an unsure byte ends no space.
_IN_SPACE = np.zeros(256, dtype=bool)
_IN_SPACE[[0xC2, 0x9A, 0x80, 0x81]] = True


def cut_at_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece: a white-space run, or a sign after a letter. Row starts are starts."""
    kinds = np.frombuffer(data.tobytes().translate(_KINDS), dtype=np.uint8)
    met = kinds[1:] & (kinds[:-1] << 1)
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = (met & 10) != 0
    unsure = np.flatnonzero(met & 32) + 1
    begins[unsure[~_IN_SPACE[data[unsure - 2]]]] = True
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def cut_at_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every run of blanks (byte 32); every row that is not empty begins with one."""
    blank = data == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


class Ids:
    """Ids of a batch: ``flat`` and the n + 1 ``offsets`` of its rows."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        self.flat, self.offsets = flat, offsets


class PieceMemory:
    """Encodes texts piece by piece with ``encode`` (distinct pieces -> flat ids and offsets)."""

    def __init__(self, encode: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], cut=cut_at_spaces):
        self._encode, self._cut = encode, cut
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._chars = 0
        self._flat = np.zeros(0, dtype=np.int32)
        self._starts = np.zeros(0, dtype=np.int64)
        self._lengths = np.zeros(0, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        flat, offsets = self._encode(pieces)
        self._chars += sum(map(len, pieces))
        self._place.update(zip(pieces, range(len(self._place), len(self._place) + len(pieces))))
        self._starts = np.concatenate([self._starts, offsets[:-1] + len(self._flat)])
        self._lengths = np.concatenate([self._lengths, np.diff(offsets)])
        self._flat = np.concatenate([self._flat, flat.astype(np.int32)])

    def __call__(self, column: pa.Array) -> Ids:
        data, offsets = text_buffer(column)
        if len(data) == 0:
            return Ids(np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64))
        begins = self._cut(data, offsets)
        borders = np.append(begins, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._place) > REMEMBERED or self._chars > REMEMBERED_CHARS:
            self._forget()
        fresh = [word for word in words if word not in self._place]
        if fresh:
            self._learn(fresh)
        places = np.fromiter(map(self._place.__getitem__, words), dtype=np.int64, count=len(words))
        places = places[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self._lengths[places]
        ends = np.append(0, np.cumsum(lengths))
        return Ids(self._flat[gathered(self._starts[places], lengths)], ends[np.searchsorted(begins, offsets)])


#: Bytes of text cut and encoded at once.
CHUNK = 8 << 20
#: Pieces whose ids are gathered at once, and words given to a tokenizer in one call.
STRIP = 1 << 16


def in_chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in batches of ``CHUNK`` bytes of text or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class PieceTable:
    """Encodes the distinct pieces of a column at once: ``encode`` makes flat ids and offsets of an Arrow array of texts.

    Nothing is kept from one column to the next, so it suits columns of many rows.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self._encode = encode

    def _coded(self, column: pa.Array):
        data, offsets = text_buffer(column)
        begins = cut_at_spaces(data, offsets)
        borders = np.append(begins, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        flat, bounds = self._encode(coded.dictionary)
        places = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.diff(bounds)[places]
        ends = np.append(0, np.cumsum(lengths))
        return flat, bounds, places, lengths, ends, ends[np.searchsorted(begins, offsets)]

    def sizes(self, column: pa.Array) -> np.ndarray:
        """How many ids every row has."""
        return np.diff(self._coded(column)[-1])

    def __call__(self, column: pa.Array) -> Ids:
        flat, bounds, places, lengths, ends, offsets = self._coded(column)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        for low in range(0, len(places), STRIP):
            high = min(low + STRIP, len(places))
            out[ends[low] : ends[high]] = flat[gathered(bounds[places[low:high]], lengths[low:high])]
        return Ids(out, offsets)


def _put(lengths: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of all pieces, from parts (pieces, ids of these one after the other)."""
    bounds = np.append(0, np.cumsum(lengths))
    flat = np.empty(int(bounds[-1]), dtype=np.int32)
    for at, ids in parts:
        flat[gathered(bounds[at], lengths[at])] = ids
    return flat, bounds


def _one_by_one(encode: Callable[[Sequence[str]], Sequence[Sequence[int]]], pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of pieces that are encoded each for itself."""
    found = encode(pieces)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    return lengths, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum()))


_BLANKS = " \t\n\r\f\v"
#: What ``library_memory`` must find in a tokenizer to give it words without its first two steps.
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: Letters of ASCII, Latin-1 and Latin Extended-A, lower-cased: composed, one lower-case letter each. Without U+0130, which becomes two.
_WORD = "^[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
_WORD_ANY = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"


def _whole_words(tokenizer):
    """A function from an array of lower-case words of letters to lengths and ids, or None where the tokenizer is of another kind.

    Where letters are one word each, lower-cased and in composed form, those steps change nothing: the model encodes many words in
    one call, and the ids that end a word tell where the next begins.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return None
    normal, split = (json.loads(part.__getstate__()) for part in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    first, *others = split.get("pretokenizers", [{}])
    known = normal.get("normalizers") == _LOWERED and first.get("pattern") == _SPLIT and first.get("behavior") == "Removed" and first.get("invert")
    if not known or [part["type"] for part in others] != ["ByteLevel"] or others[0]["add_prefix_space"] or others[0]["use_regex"]:
        return None
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    last[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths, flat = [], []
        for low in range(0, len(words), STRIP):
            part = words.slice(low, STRIP)
            joined = " ".join(part.to_pylist())
            ids = np.array(model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = np.flatnonzero(last[ids])
            if len(ends) != len(part):
                raise RuntimeError("words and their last ids differ in number")
            lengths.append(np.diff(ends, prepend=-1))
            flat.append(ids)
        return np.concatenate(lengths), np.concatenate(flat)

    return encode


def library_memory(model: bytes, special_as_text: bool = False, fold: bool | Callable[[str], str] = False) -> PieceTable:
    """Encodes columns with a tokenizer file of the ``tokenizers`` library; no special tokens are added.

    With ``fold``, pieces that a tokenizer cannot tell apart that drops white space and letter case are encoded once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    if special_as_text:
        tokenizer.encode_special_tokens = True
    whole = _whole_words(tokenizer) if fold else None

    def each(pieces: Sequence[str]) -> list[list[int]]:
        return [item.ids for item in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def plain(pieces: pa.Array) -> pa.Array:
        trimmed = pc.ascii_trim(pieces, _BLANKS)
        simple = pc.and_not(pc.string_is_ascii(pieces), pc.match_substring(pieces, "<|"))
        known = pc.if_else(simple, pc.ascii_lower(trimmed), pieces)
        if whole is None:
            return known
        return pc.if_else(pc.and_not(pc.match_substring_regex(trimmed, _WORD_ANY), simple), pc.utf8_lower(trimmed), known)

    def encode(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = (plain(pieces) if fold else pieces).dictionary_encode()
        known, parts = coded.dictionary, []
        lengths = np.zeros(len(known), dtype=np.int64)
        words = pc.match_substring_regex(known, _WORD).to_numpy(zero_copy_only=False).astype(bool) if whole else np.zeros(len(known), dtype=bool)
        for at, own in ((np.flatnonzero(words), whole), (np.flatnonzero(~words), None)):
            if len(at):
                some = known.take(pa.array(at))
                lengths[at], ids = own(some) if own else _one_by_one(each, some.to_pylist())
                parts.append((at, ids))
        flat, bounds = _put(lengths, parts)
        if not fold:
            return flat, bounds
        places = coded.indices.to_numpy(zero_copy_only=False)
        return flat[gathered(bounds[places], lengths[places])], np.append(0, np.cumsum(lengths[places]))

    return PieceTable(encode)


def folded(piece: str) -> str:
    """The piece as a tokenizer sees it that drops white space and letter case; only for pieces in ASCII."""
    return piece.strip(" \t\n\r\f\v").lower() if piece.isascii() and "<|" not in piece else piece


def ranks_memory(model: bytes, pattern: str) -> PieceTable:
    """Encodes columns with a file of byte-pair ranks for the ``tiktoken`` library; there are no special tokens.

    Distinct pieces are put one after the other wherever the border between them is one that texts are cut at too, encoded in one
    call, and told apart by the bytes of their ids.
    """
    import tiktoken

    ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, model.splitlines())}
    one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    size[list(ranks.values())] = list(map(len, ranks))
    lead = b" a"  # a sign begins a piece after a letter

    def encode(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_buffer(pieces)
        first, last = _SPACE[data[offsets[:-1]]], data[offsets[1:] - 1]
        signs = _SIGN[data[offsets[:-1]]]
        joins = ~_SPACE[last] & ~_UNSURE[last] & (first | signs)
        lengths = np.zeros(len(pieces), dtype=np.int64)
        parts = []
        if joins.any():
            # Pieces that begin with a sign come last, each after the lead.
            at = np.concatenate([np.flatnonzero(joins & first), np.flatnonzero(joins & signs)])
            some, after = pieces.take(pa.array(at)), int((joins & first).sum())
            prefix, nothing = (pa.scalar(text, pa.large_string()) for text in (lead.decode(), ""))
            led = pc.binary_join_element_wise(prefix, some.slice(after), nothing)
            text, borders = text_buffer(pa.concat_arrays([some.slice(0, after), led]))
            ids = np.array(one(text.tobytes().decode()), dtype=np.int32)
            ends = np.cumsum(size[ids])
            cuts = np.concatenate([borders[1 : after + 1], np.stack([borders[after:-1] + len(lead), borders[after + 1 :]], axis=1).ravel()])
            found = np.searchsorted(ends, cuts)
            if len(ends) and (ends[np.minimum(found, len(ends) - 1)] != cuts).any():
                raise RuntimeError("an id crosses the border of two pieces")
            runs = np.diff(found, prepend=-1)
            own = np.append(np.ones(after, dtype=bool), np.tile([False, True], len(at) - after))
            lengths[at] = runs[own]
            parts.append((at, ids[np.repeat(own, runs)]))
        if not joins.all():
            at = np.flatnonzero(~joins)
            lengths[at], ids = _one_by_one(lambda some: list(map(one, some)), pieces.take(pa.array(at)).to_pylist())
            parts.append((at, ids))
        return _put(lengths, parts)

    return PieceTable(encode)
