"""Encoding, shards and packing against the libraries, as exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from firmlens.llm.packing import Plan, pack
from firmlens.llm.piece_bpe import PieceModel, decode, encode
from firmlens.llm.segments import cut_at_spaces, folded, library_memory, ranks_memory
from firmlens.llm.token_shards import read_sequence, slots, write_shards

PIECES = public_tokenizers.path("piece_bpe_32k.model")
POOL = "abcdehinortz     \t\n the and ing éèñ中文字한국😀ﬁ 　▁\x85́<s></s><unk><0x0A>&#$%'s|."
DOCS = "doc_id long, text string, ids string, id int, shard int, rest int"


def texts(count=400, seed=1):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(1, 300))) for _ in range(count)]
    return [None, "", " ", "   ", "\n", "a", "<s> hi </s>", " " * 5000 + "x", "ab" * 3000, "中文" * 2500, *made]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "c", 1, 2, 3) for k, t in rows], DOCS)


def test_pieces_match_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = texts()
    rows = decode(encode(frame(spark, list(enumerate(given)) + [(None, "x"), (3, "x")]), PIECES), PIECES).collect()
    assert len(rows) == len(given) + 2
    for row in rows:
        if row.doc_id is not None and (row.doc_id != 3 or len(row.ids) > 1):
            expected = library.encode(given[row.doc_id] or "")
            assert list(row.ids) == expected and row.text == library.decode(expected)
    assert encode(frame(spark, []), PIECES).count() == 0


def test_any_ids_decode_as_the_library_does():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = PieceModel(open(PIECES, "rb").read())
    rnd = random.Random(5)
    rows = [[rnd.randrange(32000 if rnd.random() < 0.6 else 262) for _ in range(rnd.randint(0, 20))] for _ in range(800)]
    offsets = np.append(0, np.cumsum([len(r) for r in rows]))
    assert model.decode(np.array([x for r in rows for x in r]), offsets) == library.decode(rows)


def test_cutting_at_spaces_changes_no_ids():
    given = [t for t in texts(1500, 9) if t is not None] + ["<|endoftext|> a<|startoftext|>b", "don't I'll x''s 's"]
    for path, special in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        data = open(public_tokenizers.path(path), "rb").read()
        library = Tokenizer.from_buffer(data)
        library.encode_special_tokens = special
        expected = [item.ids for item in library.encode_batch(given, add_special_tokens=False)]
        memories = [library_memory(data, special, None if special else folded)]
        if special:
            ranks = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
            memories.append(ranks_memory(ranks, public_tokenizers.PATTERN))
        for memory in memories:
            ids = memory(pa.array(given))
            assert [ids.flat[a:b].tolist() for a, b in zip(ids.offsets[:-1], ids.offsets[1:])] == expected


def test_slots_are_a_permutation():
    for total in (1, 2, 3, 5, 64, 1000, 4097):
        places = slots(np.arange(total), total, key=99)
        assert sorted(places.tolist()) == list(range(total))
    assert slots(np.arange(50), 50, 1).tolist() != slots(np.arange(50), 50, 2).tolist()


def test_shards_hold_every_id_once(spark, tmp_path):
    given = list(enumerate(texts(60, 4))) + [(None, "null id")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    index = write_shards(frame(spark, given), path, public_tokenizers.PATTERN, 50256, folder=str(tmp_path), length=64, per_shard=40).collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    found = defaultdict(dict)
    for row in index:
        ids = read_sequence(str(tmp_path), row.slot, length=64, per_shard=40)
        assert row.shard == row.slot // 40 and row.record == row.slot % 40 and zlib.crc32(ids.tobytes()) == row.crc32
        found[row.doc_id][row.piece] = ids
    for doc, text in given:
        ids = np.concatenate([found[doc][k] for k in sorted(found[doc])]).tolist()
        assert ids == library.encode(text or "", add_special_tokens=False).ids + [50256]
    assert write_shards(frame(spark, []), path, public_tokenizers.PATTERN, 50256, folder=str(tmp_path / "none")).count() == 0


def check_pieces(rows, given, window):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
    for doc, text in given:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for piece in sorted(by_doc[doc], key=lambda p: p.start):
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + piece.length].tobytes()) == piece.ids_crc32
            at += piece.length
        assert at == len(ids)
    sizes = []
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
        sizes.append(at)
    assert sum(size < window for size in sizes) <= 1
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_is_whole_and_full(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    path = public_tokenizers.path("word_bpe_49k.json")
    check_pieces(pack(docs, path).collect(), given, 2048)
    odd = [(k, t) for k, t in enumerate(texts(30, 8))]
    check_pieces(pack(frame(spark, odd), path, window=64).collect(), odd, 64)
    twice = pack(frame(spark, [(1, "one two"), (1, "one two"), (None, None)]), path, window=64).collect()
    assert len(twice) >= 3 and sum(r.length for r in twice) == 7
    assert pack(frame(spark, []), path).count() == 0


def test_plan_uses_every_rest_once():
    counts = np.random.default_rng(2).poisson(3, 256)
    counts[0] = 0
    plan = Plan(counts, 256)
    used = defaultdict(list)
    for length in range(1, 256):
        for number in range(counts[length]):
            pieces = plan.pieces(length, number)
            assert sum(p[1] for p in pieces) == length
            for _, size, sequence, offset in pieces:
                used[sequence].append((offset, size))
    for spans in used.values():
        spans.sort()
        assert all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:])) and spans[0][0] == 0


@pytest.mark.parametrize("counts, window", [({1500: 100_000}, 2048), ({1025: 3, 1: 5000, 2047: 40}, 2048), ({2: 7}, 3), ({}, 2048)])
def test_residuals_are_cut_once_at_most(counts, window):
    lengths = np.zeros(window, dtype=np.int64)
    for length, many in counts.items():
        lengths[length] = many
    plan = Plan(lengths, window)
    total, cuts, free = 0, 0, defaultdict(int)
    for length, many in counts.items():
        for number in range(many):
            pieces = plan.pieces(length, number)
            assert len(pieces) <= 2 and sum(piece[1] for piece in pieces) == length
            total, cuts = total + length, cuts + len(pieces) - 1
            for _, size, sequence, _ in pieces:
                free[sequence] += size
    assert len(free) == plan.exact_sequences + plan.line_sequences == -(-total // window)
    assert sum(size < window for size in free.values()) <= 1 and cuts <= plan.line_sequences


def test_windows_of_any_size_and_equal_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    given = [(k, t) for k, t in enumerate(texts(40, 9))]
    docs = frame(spark, given).repartition(5)
    check_pieces(pack(docs, path, window=37).collect(), given, 37)
    same = frame(spark, [(None, None)] * 300 + [(5, "one two three four")] * 300).repartition(7)
    rows = pack(same, path, window=64).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert sum(length for _, _, length in places) == 300 + 300 * 5 and len(rows) <= 600 + 29
    assert all(b == ((a[0], a[1] + a[2]) if a[1] + a[2] < 64 else (a[0] + 1, 0)) for a, b in zip(places, [p[:2] for p in places[1:]]))


def test_a_memory_is_bounded_by_characters(monkeypatch):
    from firmlens.llm import segments

    memory = segments.PieceMemory(lambda pieces: (np.zeros(len(pieces), np.int32), np.arange(len(pieces) + 1)))
    monkeypatch.setattr(segments, "REMEMBERED_CHARS", 100)
    memory(pa.array(["x" * 200]))
    memory(pa.array(["y"]))
    assert list(memory._place) == ["y"]


LATIN = "".join(map(chr, [*range(0xC0, 0x180), 0x1C, 0x85, 0xA0, 0xAA, 0xB5, 0x300, 0x301, 0x2003, 0x2028, 0x3000, 0x430, 0x1E9E, 0x4E2D, 0x20A9]))


def mixed_words(count=300, seed=3):
    rnd = random.Random(seed)
    pool = LATIN + "abcXYZ" * 20 + "     \n\t.,'(&|019"
    made = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 200))) for _ in range(count)]
    return [*made, *LATIN, *(f" {c}a" for c in LATIN), *(f"a{c} b" for c in LATIN), "l'été don't 's", "İ ŉ ſ ĲŸ", "<|endoftext|> été", ""]


def test_texts_are_cut_after_letters_of_two_bytes():
    def cuts(text):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return cut_at_spaces(raw, np.array([0, len(raw)])).tolist()

    assert cuts("é a") == [0, 2] and cuts("à\nи b") == [0, 2, 5]
    assert cuts("a\u00a0 b") == cuts("\u2029 b") == cuts("\u1680 b") == cuts("\x1c b") == [0]


def test_whole_columns_encode_as_the_libraries_do():
    given = mixed_words()
    for path, special in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        data = open(public_tokenizers.path(path), "rb").read()
        library = Tokenizer.from_buffer(data)
        library.encode_special_tokens = special
        expected = [library.encode(text, add_special_tokens=False).ids for text in given]
        memory = library_memory(data, fold=True)
        if special:
            memory = ranks_memory(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
        ids = memory(pa.array(given))
        assert [ids.flat[a:b].tolist() for a, b in zip(ids.offsets[:-1], ids.offsets[1:])] == expected
        assert memory.sizes(pa.array(given)).tolist() == list(map(len, expected))
        assert memory.sizes(pa.array([None, ""])).tolist() == [0, 0] and len(memory(pa.array([], pa.string())).flat) == 0


def test_many_pieces_are_encoded_in_few_calls(monkeypatch):
    import tiktoken

    calls = []

    class Counted:
        def __init__(self, *args, **options):
            core = real(*args, **options)._core_bpe
            self._core_bpe = self
            self.encode_ordinary = lambda text: calls.append(text) or core.encode_ordinary(text)

    real = tiktoken.Encoding
    monkeypatch.setattr(tiktoken, "Encoding", Counted)
    memory = ranks_memory(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    memory(pa.array([f"x word{k} été{k}, (and)" for k in range(1000)]))
    assert 1 <= len(calls) <= 3


def test_chunks_keep_all_rows_in_order(monkeypatch):
    from firmlens.llm import segments

    monkeypatch.setattr(segments, "CHUNK", 50)
    batches = [pa.RecordBatch.from_pydict({"t": pa.array([f"row {k}", None])}) for k in range(40)]
    chunks = list(segments.in_chunks(iter(batches), 0))
    assert 1 < len(chunks) < 40
    assert [t for chunk in chunks for t in chunk.column(0).to_pylist()] == [t for batch in batches for t in batch.column(0).to_pylist()]
    assert list(segments.in_chunks(iter([]), 0)) == []
