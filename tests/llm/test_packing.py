"""Packing: ids against the tokenizers library, gapless places, near the lower bound."""
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import packing as P
from ledgerline.llm.tokens import WordTokenizer
from tests_llm_util import frame

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = WordTokenizer(PATH)


def lib(text):
    return b"".join(struct.pack("<I", i) for i in LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [
    "", " ", "a", "It's they'RE 'sx '' 's!'s I'll've", "ÀÉß µº ²½ x²y 3.14", "a\x1cb c\x85d\xa0e\xadf", "<|endoftext|> a",
    "x<|startoftext|>y", "中文 한국어 ΑΣ Σ İI", "é é ﬁ", "\t\n\r\x0b\x0c", "THE!! the%%% a|b", "a" * 3000, "\x7f\x00\x01", "ªº¼"])
def test_ids_of_hard_texts(text):
    assert OWN.ids([text, "the end", text]) == [lib(text), lib("the end"), lib(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" 'sStTdDlLmMvVrReE!.0é|<>"), st.characters(max_codepoint=255),
                                           st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_ids_of_any_texts(texts):
    assert OWN.ids(texts) == [lib(t) for t in texts]


def test_ids_when_caches_overflow(monkeypatch):
    for memory in ("KNOWN", "YOUNG"):
        monkeypatch.setattr(f"ledgerline.llm.tokens.{memory}_ENTRIES", 5)
    own = WordTokenizer(PATH)
    texts = [f"w{i} some x{i % 3} more y" for i in range(20)]
    assert own.ids(texts) == [lib(t) for t in texts] and own.ids(texts[:3]) == [lib(t) for t in texts[:3]]


def test_signs_beside_words_go_through_the_merges_once():
    own, seen = WordTokenizer(PATH), []
    real = own.model

    class Counted:
        def tokenize(self, word):
            seen.append(word)
            return real.tokenize(word)

    own.model = Counted()
    texts = [f"wörd{chr(97 + i)},,, it's{chr(97 + i)} 7{chr(97 + i)}!? ..." for i in range(20)]
    assert own.ids(texts) == [lib(t) for t in texts]
    assert all(seen.count(w) == 1 for w in (",,,", "'s", "7", "!?", "..."))
    assert len(own._signs) == 5


def test_signs_remembered_stay_bounded(monkeypatch):
    monkeypatch.setattr("ledgerline.llm.tokens.SIGN_ENTRIES", 3)
    own = WordTokenizer(PATH)
    texts = ["".join(random.Random(i).choices("!?.,;:-+", k=9)) + "a" for i in range(50)]
    assert own.ids(texts) == [lib(t) for t in texts] and len(own._signs) == 3


def test_ids_of_every_latin_1_character():
    import random
    rnd = random.Random(1)
    texts = ["".join(map(chr, range(256))), "don't I'LL ÀÉß ÿµª x²y½ 'S 're''d \x00a\x7fb\xadc\xa0d\x85e", "ſ K İ straße"]
    texts += ["".join(chr(rnd.randrange(256)) for _ in range(200)) for _ in range(300)]
    assert WordTokenizer(PATH).ids(texts) == [lib(t) for t in texts]


def placed(rows, capacity):
    """Checks the places; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_island_beats_or_equals_best_fit_and_reaches_the_bound():
    rng = random.Random(3)
    for trial in range(5):
        cap, lengths = 100, []
        for _ in range(40):                       # bins that can be filled exactly
            a, b = sorted(rng.sample(range(15, 86), 2))
            lengths += [a, b - a, cap - b]
        first = P.best_fit(lengths, P._descending(lengths, range(len(lengths))), [], cap)
        best = P.evolve(lengths, [], cap, trial)
        assert sorted(i for b in best for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= cap for b in best)
        assert 40 <= len(best) <= len(first)


def optimum(lengths, capacity):
    """Fewest bins by trying everything."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(order):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= order[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - order[i], *rooms[k + 1:]])
        go(i + 1, [*rooms, capacity - order[i]])
    order = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_no_packing_beats_the_bound(case):
    capacity, lengths = case
    best = optimum(lengths, capacity)
    assert -(-sum(lengths) // capacity) <= P.least_bins(lengths, capacity) <= best
    assert len(P.evolve(lengths, [], capacity, 1)) >= best


def test_bound_counts_pieces_over_half():
    assert P.least_bins([60] * 30, 100) == 30 and P.least_bins([60] * 10 + [40] * 10, 100) == 10
    assert P.least_bins([60] * 10 + [41] * 10, 100) == 15 and P.least_bins([], 100) == 0


def test_crossover_keeps_every_piece_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    a = P.best_fit(lengths, range(200), [], 100)
    b = P.best_fit(lengths, P._descending(lengths, range(200)), [], 100)
    c = P.crossover(lengths, a, b, 100, rng)
    assert sorted(i for x in c for i in x) == list(range(200))
    assert all(sum(lengths[i] for i in x) <= 100 for x in c)


def test_query_on_whole_fixture(spark):
    from ledgerline.llm.queries import op3_pack
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = op3_pack(spark, "/root/testdata/sf0.001").collect()
    want, total = {}, 0
    for r in docs:
        ids = lib(r.text) + struct.pack("<I", 1)
        total += len(ids) // 4
        for k, a in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[a:a + 4 * 4096]
            want[r.doc_id, k] = (k * 4096, len(part) // 4, zlib.crc32(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert placed(rows, 4096) <= -(-total // 4096) + 1


def test_nulls_repeats_long_texts_and_small_blocks(spark):
    texts = [None, "", "a", "a", "word " * 9000] + [f"some words {i} " * (i % 50) for i in range(300)]
    df = frame(spark, [(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = P.pack_documents(df, PATH, capacity=256, block_size=40, islands=2).collect()
    total = sum(len(lib(t or "")) // 4 + 1 for t in texts)
    assert sum(r.length for r in rows) == total
    assert placed(rows, 256) <= 1.05 * total / 256 + 2
    assert P.pack_documents(df.limit(0), PATH).count() == 0


def test_hot_length_and_large_pieces(spark):
    df = frame(spark, [(i, 0, 0, 150 if i % 3 else 100, 0) for i in range(500)],
               "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = P.pack(df, capacity=256, block_size=64, islands=2).collect()
    assert len(rows) == 500 and placed(rows, 256) <= 335
