"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line has a few shares in [0, 1] as features (signs, capitals, digits, bars, repeats, form). The field's
weights are fitted on a bounded sample of labelled documents; the Viterbi path of a document labels its
lines, and a document is kept if lines marked as content hold at least half of its words. Two base rules
come first: too few words, or too many words in eight-word windows that occur twice or more.

Counts are exact and made in one pass over whole texts with array operations on the bytes of a batch; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.shingles import WordHasher, mixed, text_buffer, windows

#: Labelled documents, and lines of each, that the weights are fitted on at most.
SAMPLE_DOCS = 1500
SAMPLE_LINES = 60
WINDOW = 8
FEATURES = 15

_JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_words long"
)


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL = _bytes_in(b"#*$%&|<>")
_UPPER = _bytes_in(bytes(range(65, 91)))
_LETTER = _bytes_in(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGIT = _bytes_in(b"0123456789")
_STOP = _bytes_in(b".!?;:\"')")


@dataclass
class Lines:
    """Counts per row and features per line of a batch; only lines with a word are lines."""

    row_words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    dup_lines: np.ndarray
    repeat_words: np.ndarray
    line_row: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(mask, dtype=np.int64))


def measured(column: pa.Array, hasher: WordHasher) -> Lines:
    """Line features and exact counts of a text column; nulls count as empty."""
    data, offsets = text_buffer(column)
    rows = len(offsets) - 1
    starts, ends, words = hasher.words(data, offsets)
    cuts = np.searchsorted(starts, offsets)
    row_words = np.diff(cuts)
    glyph = (data & 0xC0) != 0x80
    char_sums, symbol_sums = _sums(glyph), _sums(_SYMBOL[data])
    word_row = np.repeat(np.arange(rows), row_words)
    word_chars = np.bincount(word_row, weights=char_sums[ends] - char_sums[starts], minlength=rows).astype(np.int64)
    symbols = symbol_sums[offsets[1:]] - symbol_sums[offsets[:-1]]

    repeated = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= WINDOW:
        runs = windows(words, WINDOW)
        inside = word_row[: len(runs)] == word_row[WINDOW - 1 :]
        places = np.flatnonzero(inside)
        keyed = runs[places] ^ mixed(word_row[places].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keyed, kind="stable")
        same = keyed[order][1:] == keyed[order][:-1]
        again = places[order[np.append(same, False) | np.append(False, same)]]
        np.add.at(repeated, again, 1)
        np.subtract.at(repeated, again + WINDOW, 1)
    in_repeat = np.cumsum(repeated[:-1]) > 0 if len(words) else np.zeros(0, dtype=bool)
    repeat_words = np.bincount(word_row, weights=in_repeat, minlength=rows).astype(np.int64)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    first = np.searchsorted(starts, line_starts)
    count = np.diff(np.append(first, len(starts)))
    real = count > 0
    line_starts, line_ends, first, count = line_starts[real], line_ends[real], first[real], count[real]
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    text_hash = hasher.spans(data, line_starts, line_ends) ^ mixed(line_row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(text_hash, kind="stable")
    dup = np.zeros(len(text_hash), dtype=bool)
    dup[order[1:]] = text_hash[order[1:]] == text_hash[order[:-1]]
    dup_lines = np.bincount(line_row, weights=dup, minlength=rows).astype(np.int64)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = _sums(mask)
        return (sums[line_ends] - sums[line_starts]) / np.maximum(of, 1)

    def word_share(mask: np.ndarray) -> np.ndarray:
        sums = _sums(mask)
        return (sums[first + count] - sums[first]) / count

    letter = _LETTER[data]
    letter_sums = _sums(letter)
    letters = letter_sums[line_ends] - letter_sums[line_starts]
    chars = char_sums[line_ends] - char_sums[line_starts]
    has_symbol = symbol_sums[ends] > symbol_sums[starts]
    has_letter = letter_sums[ends] > letter_sums[starts]
    stutter = np.append(False, (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1])) if len(words) else np.zeros(0, bool)
    last = data[np.maximum(ends[first + count - 1] - 1, 0)] if len(first) else np.zeros(0, np.uint8)
    begins = data[starts[first]] if len(first) else np.zeros(0, np.uint8)
    features = np.stack([
        np.ones(len(count)),
        word_share(has_symbol),
        share(_UPPER[data], letters),
        share(data == 33, count),
        word_share(~has_letter),
        share(_DIGIT[data], chars),
        word_share(in_repeat),
        dup.astype(float),
        (count < 4).astype(float),
        _STOP[last].astype(float),
        (_UPPER[begins] | (begins >= 0x80)).astype(float),
        np.minimum(np.log1p(count) / 6.0, 1.0),
        word_share(stutter),
        (word_share(has_symbol) > 0.15).astype(float),
        (word_share(stutter) > 0.3).astype(float),
    ], axis=1) if len(count) else np.zeros((0, FEATURES))
    features[:, 3] = np.minimum(features[:, 3], 1.0)
    return Lines(row_words, word_chars, symbols, dup_lines, repeat_words, line_row, count, features)


@dataclass
class Field:
    """Weights of a two-label chain: label 1 is content. ``steps[a, b]`` scores label b after label a."""

    weights: np.ndarray
    steps: np.ndarray

    def labels(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of all chains, laid out one after the other; equal scores go to content."""
        out = np.ones(len(scores), dtype=np.int8)
        begin = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order):
            return out
        begin, size = begin[order], lengths[order]
        best = np.stack([np.zeros(len(order)), scores[begin]], axis=1)
        back = np.zeros((len(scores), 2), dtype=np.int8)
        for at in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -at, side="left"))
            here = begin[:live] + at
            via = best[:live, :, None] + self.steps[None]
            back[here] = via[:, 1, :] >= via[:, 0, :]
            best[:live] = via.max(axis=1)
            best[:live, 1] += scores[here]
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for at in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -at, side="left"))
            here = begin[:live] + at
            out[here] = label[:live]
            if at:
                label[:live] = back[here, label[:live]]
        return out


#: Used where no labelled documents exist: signs, capitals, shouting and repeats speak against a line.
UNFITTED = Field(
    np.array([3.0, -8.0, -6.0, -4.0, -3.0, -3.0, -5.0, -3.0, -0.3, 0.5, 0.3, 0.5, -6.0, -2.0, -2.0]), np.array([[1.0, -1.0], [-1.0, 1.0]])
)


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def fitted(features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, keep: float = 0.02) -> Field:
    """Maximum-likelihood weights of the chain (gradient steps with momentum, weights kept small by ``keep``)."""
    order = sorted(range(len(features)), key=lambda k: -len(features[k]))
    size = np.array([len(features[k]) for k in order])
    longest = int(size[0])
    x = np.zeros((len(order), longest, FEATURES))
    y = np.zeros((len(order), longest), dtype=np.int64)
    for row, k in enumerate(order):
        x[row, : size[row]], y[row, : size[row]] = features[k], labels[k]
    live = [int(np.searchsorted(-size, -at, side="left")) for at in range(longest)]
    weights, steps = UNFITTED.weights * 0.0, UNFITTED.steps * 0.0
    speed_w, speed_s = np.zeros_like(weights), np.zeros_like(steps)
    lines = size.sum()
    for _ in range(rounds):
        scores = x @ weights
        ahead = np.zeros((len(order), longest, 2))
        ahead[:, 0, 1] = scores[:, 0]
        for at in range(1, longest):
            n = live[at]
            prior = ahead[:n, at - 1]
            for b in (0, 1):
                ahead[:n, at, b] = _soft(prior[:, 0] + steps[0, b], prior[:, 1] + steps[1, b]) + b * scores[:n, at]
        behind = np.zeros((len(order), longest, 2))
        for at in range(longest - 2, -1, -1):
            n = live[at + 1]
            nxt = behind[:n, at + 1] + np.stack([np.zeros(n), scores[:n, at + 1]], axis=1)
            for a in (0, 1):
                behind[:n, at, a] = _soft(steps[a, 0] + nxt[:, 0], steps[a, 1] + nxt[:, 1])
        total = _soft(ahead[:, 0, 0] + behind[:, 0, 0], ahead[:, 0, 1] + behind[:, 0, 1])
        mask = np.arange(longest)[None] < size[:, None]
        belief = np.where(mask, np.exp(np.minimum(ahead[:, :, 1] + behind[:, :, 1] - total[:, None], 0)), 0)
        push_w = np.einsum("rl,rlf->f", np.where(mask, y - belief, 0), x) / lines - keep * weights / len(weights)
        push_s = np.zeros((2, 2))
        for at in range(1, longest):
            n = live[at]
            for a in (0, 1):
                for b in (0, 1):
                    chance = np.exp(np.minimum(ahead[:n, at - 1, a] + steps[a, b] + b * scores[:n, at] + behind[:n, at, b] - total[:n], 0))
                    push_s[a, b] += ((y[:n, at - 1] == a) & (y[:n, at] == b)).sum() - chance.sum()
        push_s = push_s / lines - keep * steps
        speed_w, speed_s = 0.9 * speed_w + push_w, 0.9 * speed_s + push_s
        weights, steps = weights + 2.0 * speed_w, steps + 0.5 * speed_s
    return Field(weights, steps)


class _Sampled:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        for batch in batches:
            lines = measured(batch.column(1), hasher)
            cuts = np.searchsorted(lines.line_row, np.arange(batch.num_rows + 1))
            raw = [lines.features[a:b][:SAMPLE_LINES].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["quality", "features"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Field fitted on at most ``sample_docs`` labelled documents, those with the smallest hashes of their id.

    Lines of a good document count as content, lines of a bad one as boilerplate. Documents without words teach
    nothing; without documents of both kinds the field is ``UNFITTED``.
    """
    chosen = (
        labels.where(f"quality in (0, 1) and {id_col} is not null").groupBy(id_col).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(F.col(id_col).cast("long")), id_col).limit(sample_docs)
    )
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), id_col)  # at most ``sample_docs`` rows
    rows = texts.select("quality", "text").mapInArrow(_Sampled(), "quality int, features binary").collect()
    found = sorted((row["quality"], bytes(row["features"])) for row in rows if row["features"])
    if len({quality for quality, _ in found}) < 2:
        return UNFITTED
    features = [np.frombuffer(raw, dtype=np.float32).reshape(-1, FEATURES).astype(float) for _, raw in found]
    return fitted(features, [np.full(len(own), quality) for own, (quality, _) in zip(features, found)])


class _Judge:
    def __init__(self, field: Field, min_words: int, max_repeat: int, min_share: float):
        self._field, self._min_words, self._max_repeat, self._min_share = field, min_words, max_repeat, min_share

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=False)
        names = [part.split(" ")[0] for part in _JUDGED.split(", ")]
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                lines = measured(part.column(1), hasher)
                rows = part.num_rows
                sizes = np.bincount(lines.line_row, minlength=rows)
                labels = self._field.labels(lines.features @ self._field.weights, sizes)
                content = np.bincount(lines.line_row, weights=labels * lines.line_words, minlength=rows).astype(np.int64)
                words = lines.row_words
                failed = (words < self._min_words) | (100 * lines.repeat_words > self._max_repeat * words)
                kept = ~failed & (content >= self._min_share * words)
                marked = np.bincount(lines.line_row, weights=labels, minlength=rows).astype(np.int64)
                columns = [words, lines.word_chars, lines.symbols, lines.dup_lines, lines.repeat_words, failed, kept, sizes, marked, content]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=names)


def judge(
    docs: DataFrame, field: Field, min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines,
    n_content_lines, content_words).

    A null, empty or blank text has no words, fails the base rule and is not kept. Repeated rows and rows
    without an id are judged like any other; further columns are left out; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(_Judge(field, min_words, max_repeat, min_share), _JUDGED)
    return out.withColumnRenamed("doc_id", id_col)


class _Filter(_Judge):
    """Rows of the input that are kept, with all their columns; the text is column ``text_at``."""

    def __init__(self, judge_: _Judge, text_at: int):
        self.__dict__.update(judge_.__dict__)
        self._text_at = text_at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            pairs = pa.RecordBatch.from_arrays([ids, batch.column(self._text_at)], names=["doc_id", "text"])
            verdicts = [part.column("kept") for part in super(_Filter, self).__call__(iter([pairs]))]
            yield batch.filter(pa.chunked_array(verdicts).combine_chunks()) if verdicts else batch


def keep_good(docs: DataFrame, field: Field, min_words: int = 20, max_repeat: int = 30, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns, in one pass and without a join."""
    judge_ = _Judge(field, min_words, max_repeat, min_share)
    return docs.mapInArrow(_Filter(judge_, docs.columns.index(text_col)), docs.schema)
