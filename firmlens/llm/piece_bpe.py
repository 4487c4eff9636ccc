"""Encoding and decoding with a SentencePiece byte-pair model, in vectorised merge rounds.

The file is read by the public library for its vocabulary only. A text becomes blank-led words; the distinct
words of a batch are laid out as one flat array of symbols. In every round each word takes its smallest pair
rank (a segmented minimum), all its leftmost non-overlapping occurrences of that pair are merged at once, and the
array is compacted; words without a pair leave. A merged piece that could at once form a better or an equal
pair is merged at its leftmost place only, which keeps the order of the library. Words of very many
symbols are merged one at a time with a heap, in the same order. What is in no piece falls back to bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import model_file
from firmlens.llm.segments import Ids, PieceMemory, cut_at_marks, gathered

MARK = "▁"
#: Words of more symbols are merged with a heap: rounds over them would each move the whole word.
LONG_WORD = 2000
#: Texts laid out together.
ROWS = 500
_NONE = np.int64(1) << 40


class PieceModel:
    """Tables of a byte-pair model: symbols, pair ranks, bytes of every piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        count = library.get_piece_size()
        if library.normalize("  a  B ") != f"{MARK * 3}a {MARK}B{MARK}":
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        plain = [i for i in range(count) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        if any(library.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        pieces = {i: library.id_to_piece(i) for i in range(count)}
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a word border; words cannot be encoded apart")
        self.unknown = library.unk_id()
        self.byte_ids = np.full(256, self.unknown, dtype=np.int64)
        for i in range(count):
            if library.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        symbols = {pieces[i]: i for i in plain}
        self._id_count = count
        for char in sorted({c for i in plain for c in pieces[i]}):
            symbols.setdefault(char, len(symbols) + count)
        self._loose = {symbol: ord(text) for text, symbol in symbols.items() if symbol >= count}
        self._char = np.full(0x110000, -1, dtype=np.int64)
        for text, symbol in symbols.items():
            if len(text) == 1:
                self._char[ord(text)] = symbol
        self._width = np.int64(max(symbols.values()) + 1)
        scores = sorted({library.get_score(i) for i in plain}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        rank_of = {i: place[library.get_score(i)] for i in plain}
        pairs: list[tuple[int, int, int]] = []
        restless = np.zeros(count, dtype=bool)
        for i in plain:
            text = pieces[i]
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    pairs.append((left * int(self._width) + right, rank_of[i], i))
                    for part in (left, right):
                        if part < count and rank_of[i] <= rank_of[part]:
                            restless[part] = True
        pairs.sort()
        self._keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self._ranks = np.array([p[1] for p in pairs], dtype=np.int64)
        self._merged = np.array([p[2] for p in pairs], dtype=np.int64)
        self._restless = restless
        self._pair_place = {p[0]: (p[1], p[2]) for p in pairs}
        surfaces = [b"" if library.is_control(i) else pieces[i].replace(MARK, " ").encode() for i in range(count)]
        for value, i in enumerate(self.byte_ids):
            if i != self.unknown:
                surfaces[i] = bytes([value])
        surfaces[self.unknown] = " ⁇ ".encode()
        self.is_byte = np.array([library.is_byte(i) for i in range(count)])
        self.is_control = np.array([library.is_control(i) for i in range(count)])
        self.leads = np.array([pieces[i].startswith(MARK) and i in rank_of for i in range(count)])
        self._surface = np.frombuffer(b"".join(surfaces), dtype=np.uint8)
        self._surface_lengths = np.array([len(s) for s in surfaces], dtype=np.int64)
        self._surface_starts = np.append(0, np.cumsum(self._surface_lengths)[:-1])

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, or -1."""
        keys = np.where((left >= 0) & (right >= 0), left * self._width + right, -1)
        places = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[places] == keys, places, -1)

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of the words."""
        points = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self._char[points]
        symbols = np.where(symbols >= 0, symbols, -1 - points)
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        for word in np.flatnonzero(lengths > LONG_WORD):
            mine = self._one_by_one(symbols[owner == word])
            done_symbols.append(mine)
            done_owner.append(np.full(len(mine), word))
        short = lengths[owner] <= LONG_WORD
        symbols, owner = symbols[short], owner[short]
        while len(symbols):
            same = np.append(owner[1:] == owner[:-1], False)
            following = np.append(symbols[1:], -1)
            pair = np.where(same, self._looked_up(symbols, following), -1)
            rank = np.where(pair >= 0, self._ranks[pair], _NONE)
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(owner))))
            active = least < _NONE
            done_symbols.append(symbols[~active])
            done_owner.append(owner[~active])
            if not active.any():
                break
            symbols, owner, pair, hit = symbols[active], owner[active], pair[active], (rank == least)[active]
            places = np.flatnonzero(hit)
            news = self._merged[pair[places]]
            apart = np.append(True, np.diff(places) > 1)  # in a run of hits every second one overlaps the one before
            run = np.maximum.accumulate(np.where(apart, np.arange(len(places)), 0))
            taken = (np.arange(len(places)) - run) % 2 == 0
            leftmost = np.append(True, owner[places][1:] != owner[places][:-1])
            # places of one word with equal rank can name different pieces (equal scores): only the leftmost then
            first_of = np.maximum.accumulate(np.where(leftmost, np.arange(len(places)), 0))
            calm = ~self._restless[news] & (news == news[first_of])
            mixed_word = np.zeros(int(owner.max()) + 1, dtype=bool)
            mixed_word[owner[places][~calm]] = True
            taken &= leftmost | ~mixed_word[owner[places]]
            places, news = places[taken], news[taken]
            symbols = symbols.copy()
            symbols[places] = news
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return self._with_bytes(symbols[order], owner[order], len(words))

    def _one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """Merges of one long word: best rank first, leftmost first among equals."""
        values = symbols.tolist()
        count, width = len(values), int(self._width)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        known = self._pair_place
        heap = []
        for left in range(count - 1):
            found = known.get(values[left] * width + values[left + 1]) if min(values[left : left + 2]) >= 0 else None
            if found:
                heap.append((found[0], left, values[left], left + 1, values[left + 1], found[1]))
        heapq.heapify(heap)
        gone = bytearray(count)
        while heap:
            _, left, a, right, b, new = heapq.heappop(heap)
            if gone[left] or gone[right] or values[left] != a or values[right] != b or after[left] != right:
                continue
            values[left], gone[right] = new, 1
            after[left] = after[right]
            if after[right] < count:
                before[after[right]] = left
            for x, y in ((before[left], left), (left, after[left])):
                if x >= 0 and y < count and values[x] >= 0 and values[y] >= 0:
                    found = known.get(values[x] * width + values[y])
                    if found:
                        heapq.heappush(heap, (found[0], x, values[x], y, values[y], found[1]))
        return np.array([v for v, lost in zip(values, gone) if not lost], dtype=np.int64)

    def _with_bytes(self, symbols: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; symbols that are no piece become the ids of their UTF-8 bytes."""
        strange = np.flatnonzero((symbols < 0) | (symbols >= self._id_count))
        if len(strange):
            chars = self._loose
            ids = [
                self.byte_ids[np.frombuffer(chr(-1 - int(s) if s < 0 else chars[int(s)]).encode(), dtype=np.uint8)]
                for s in symbols[strange]
            ]
            widths = np.ones(len(symbols), dtype=np.int64)
            widths[strange] = [len(x) for x in ids]
            out = np.repeat(symbols, widths)
            first = np.cumsum(widths) - widths
            out[gathered(first[strange], widths[strange])] = np.concatenate(ids)
            symbols, owner = out, np.repeat(owner, widths)
        return symbols, np.searchsorted(owner, np.arange(count + 1))

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of rows of ids: pieces joined, marks to blanks, the dummy blank removed, bytes as UTF-8."""
        if len(flat) and (flat.min() < 0 or flat.max() >= self._id_count):
            raise ValueError("an id is outside the vocabulary")
        lengths = self._surface_lengths[flat]
        data = self._surface[gathered(self._surface_starts[flat], lengths)].tobytes()
        borders = np.append(0, np.cumsum(lengths))
        bytewise = self.is_byte[flat]
        out = []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            first = low
            while first < high and self.is_control[flat[first]]:
                first += 1
            begin = int(borders[low]) + int(first < high and bool(self.leads[flat[first]]))
            raw = data[begin : int(borders[high])]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._repaired(flat[low:high], bytewise[low:high], begin - int(borders[low])))
        return out

    def _repaired(self, ids: np.ndarray, bytewise: np.ndarray, skip: int) -> str:
        """Runs of byte pieces that are no UTF-8: every byte that begins no character becomes U+FFFD."""
        parts, at = [], 0
        while at < len(ids):
            if not bytewise[at]:
                start = int(self._surface_starts[ids[at]])
                parts.append(self._surface[start : start + int(self._surface_lengths[ids[at]])].tobytes().decode())
                at += 1
                continue
            run = at
            while run < len(ids) and bytewise[run]:
                run += 1
            raw = self._surface[self._surface_starts[ids[at:run]]].tobytes()
            place = 0
            while place < len(raw):
                for width in (1, 2, 3, 4):
                    try:
                        parts.append(raw[place : place + width].decode())
                        place += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    place += 1
            at = run
        return "".join(parts)[skip:]


def _prefixed(column: pa.Array) -> pa.Array:
    """Texts as the model sees them: marks as blanks, and one blank before every text that is not empty."""
    column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), MARK, " ")
    blank = pc.if_else(pc.equal(pc.binary_length(column), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return pc.binary_join_element_wise(blank, column, pa.scalar("", pa.large_string()))


class _Encode:
    def __init__(self, model):
        self._model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = None
        for batch in batches:
            if memory is None:
                memory = PieceMemory(PieceModel(self._model.value).encode_words, cut_at_marks)
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                ids: Ids = memory(_prefixed(part.column(1)))
                lists = pa.ListArray.from_arrays(pa.array(ids.offsets, pa.int32()), pa.array(ids.flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])


class _Decode:
    def __init__(self, model):
        self._model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or PieceModel(self._model.value)
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                lists = part.column(1)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                texts = model.decode(flat, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(texts, pa.large_string())], names=["id", "ids", "text"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (id_col, ids array<int>), without begin or end ids.

    Null and empty texts have no ids. Rows without an id and repeated rows are encoded like any other;
    further columns are left out, whatever their names. An empty table gives no rows.
    """
    model = model_file(docs.sparkSession, model_path)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_Encode(model), "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row (id_col, ids, text); null ids count as none, an id outside the vocabulary is an error."""
    model = model_file(rows.sparkSession, model_path)
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    source = rows.select(F.col(id_col).cast("long").alias("id"), ids.alias("ids"))
    return source.mapInArrow(_Decode(model), "id long, ids array<int>, text string").withColumnRenamed("id", id_col)
