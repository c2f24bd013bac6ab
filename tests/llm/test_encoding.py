import hashlib
import random
import zlib

import numpy as np
import pytest

from lumenfold.llm import chat_format as c
from lumenfold.llm import piece_encoding as p
from lumenfold.llm import token_output as t
from lumenfold.llm.queries import op6_chat_format, op7_token_output, op8_piece_encoding

SF = "/root/testdata/sf0.01"


def test_token_query_against_the_library(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(t.tokenizer_path())
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, at = {}, 0
    for d, x in zip(docs, own.encode_batch([d.text or "" for d in docs], add_special_tokens=False)):
        ids = np.array([*x.ids, 0], "<u4")
        want[d.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op7_token_output(spark, SF).collect()} == want


def test_units_equal_whole_texts():
    own = t.UnitEncoder(t.tokenizer_path())
    random.seed(5)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "the", "'s", " 's", "1", "42", "é", "ñandú", "!", "...", "　", "\u00a0", "😀", "don't", "\x1c"]
    for _ in range(3000):
        text = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert own.encode([text])[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_full_memo_keeps_common_units(monkeypatch):
    monkeypatch.setattr(t, "_MEMO_UNITS", 60)
    own, rng = t.UnitEncoder(t.tokenizer_path()), random.Random(4)
    learned = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: learned.extend(new) or learn(new))
    for _ in range(30):
        texts = ["the cat\nsat on the mat " + " ".join("".join(rng.choices("abcdé", k=7)) for _ in range(20)) for _ in range(2)]
        assert [x.tolist() for x in own.encode(texts)] == [own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(own.units) <= 60 + 50
    assert all(learned.count(u) == 1 for u in ("the", " cat", "\n", " mat"))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_edge_cases(spark, tmp_path, encoding):
    import pyarrow.parquet as pq

    rows = [(3, None), (1, "hello world"), (1, "hello world"), (None, "x"), (2, ""), (9, "ab " * 50_000)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    t.write_tokens(table, str(tmp_path / "t"), files=3, encoding=encoding)
    got = sorted(((r.start, r.n_tokens) for r in t.read_tokens(spark, str(tmp_path / "t")).collect()))
    assert len(got) == len(rows) and [a for a, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))]
    found = set()
    for f in (tmp_path / "t").glob("*.parquet"):
        for g in range((meta := pq.ParquetFile(f).metadata).num_row_groups):
            column = meta.row_group(g).column(3)
            found |= set(column.encodings)
            assert column.has_offset_index
    assert any("DICTIONARY" in e if encoding == "dictionary" else "DELTA" in e for e in found)
    t.write_tokens(table.limit(0), str(tmp_path / "e"))
    assert t.read_tokens(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError):
        t.write_tokens(table, str(tmp_path / "x"), encoding="plain")


def test_selective_reads(spark, tmp_path):
    table = spark.range(4000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 40) AS text")
    t.write_tokens(table, str(tmp_path / "t"), files=4, row_group_bytes=8 << 10, page_bytes=4 << 10)
    some = t.select_tokens(spark, str(tmp_path / "t"), 100, 120)
    got = {r.doc_id: len(r.ids) for r in some.collect()}
    assert sorted(got) == list(range(100, 121)) and got == {r.doc_id: r.n_tokens for r in some.collect()}
    # the bounds reach the scan: files, row groups and pages of other ids are passed over
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,120)]" in some._jdf.queryExecution().toString()
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).metadata.row_group(g) for f in (tmp_path / "t").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > 8  # small groups, so that there is something to pass over
    hit = [g for g in groups if g.column(0).statistics.min <= 120 and g.column(0).statistics.max >= 100]
    assert 1 <= len(hit) <= 2
    counts = t.token_counts(spark, str(tmp_path / "t"))
    assert counts.count() == 4000 and "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_files_follow_the_input_size(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    t.write_tokens(table, str(tmp_path / "t"), file_bytes=200_000)
    assert len(list((tmp_path / "t").glob("*.parquet"))) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_chat_query_against_brute_force(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(r[1:] for r in rows if r[0] == conv)
        loss = "".join(x for _, role, x in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[conv] = (len(turns), digest("".join(f"{role}\n{x}\n" for _, role, x in turns)), len(loss), digest(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op6_chat_format(spark, SF).collect()}
    assert got == want


def test_chat_escape_and_mask(spark):
    random.seed(1)
    parts = ["<", "|", "\\", "[INST]", "</s>", "\n", "end|>", "<|end|>", "x", " é", "😀 ", "  "]
    rows = []
    for conv in range(40):
        for turn in range(3):
            rows.append((conv, turn, random.choice(["user", "assistant", "a\\n\nb", None]), random.choice([None, "".join(random.choices(parts, k=8))])))
    rows += [(None, None, "assistant", "lost"), (None, 0, "user", "lost too"), (5, 1, "assistant", "again"), (99, 0, "assistant", "long " * 30_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    all_of = c.chat_format(table).collect()
    assert sorted(r.turns[0].text for r in all_of if r.conv_id is None) == ["lost", "lost too"]  # a conversation each
    got = {r.conv_id: r for r in all_of if r.conv_id is not None}
    for conv, r in got.items():
        turns = sorted(((-1 if a[1] is None else a[1], a[2] or "", a[3] or "") for a in rows if a[0] == conv))
        assert [(x.role, x.text) for x in r.turns] == [(b, d) for _, b, d in turns]
        assert r.loss_text == "".join(d for _, b, d in turns if b == "assistant")
    assert len(got) == 41 and c.chat_format(table.limit(0)).count() == 0


def test_offsets_equal_the_library():
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    own, lib = c.OffsetEncoder(t.tokenizer_path()), Tokenizer.from_file(t.tokenizer_path())
    lib.encode_special_tokens, lib.post_processor = True, ByteLevel(trim_offsets=False)
    random.seed(6)
    parts = [*"abc xyz\n", "é", "😀", "執", "the ", "  ", "[INST]", "</s>"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(500)]
    for (ids, starts, ends), x in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == x.ids and list(zip(starts.tolist(), ends.tolist())) == x.offsets


def test_escape_undone(spark):
    random.seed(7)
    parts = [*c.CONTROL, "<", "|", "\\", "/", "x", "[", "s>"]
    for _ in range(2000):
        text = "".join(random.choices(parts, k=random.randint(0, 10)))
        shown = c.escape(text)
        assert c.unescape(shown) == text and not any(x in shown for x in c.CONTROL)


def test_masks_cover_tokens(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "one two")], "conv_id long, turn long, role string, text string")
    r = c.format_chats(table).collect()[0]
    assert "".join(r.formatted[m.first : m.last] for m in r["mask"]) == "one two"
    assert all(0 <= m.token < len(r.ids) for m in r["mask"])


def test_piece_query_against_the_library(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=p.model_path())
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(own.encode(d.text or ""), "<u4")
        want[d.doc_id] = (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256((d.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_crc32, r.text_sha256) for r in op8_piece_encoding(spark, SF).collect()} == want


def test_pieces_against_the_library_on_odd_texts(spark):
    import sentencepiece

    own, lib = p.PieceEncoder(p.model_path()), sentencepiece.SentencePieceProcessor(model_file=p.model_path())
    random.seed(3)
    parts = [*"abcdehlost \n\t▁", "é", "執", "😀", "ing", "tion", "the ", "    "]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == lib.encode(text), repr(text)
        assert own.decode(ids) == text.replace("▁", " ")
    rows = [(1, None), (None, "a b"), (2, ""), (1, "word " * 40_000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    assert sorted(r.text for r in p.decode_pieces(p.encode_pieces(table)).collect()) == sorted(x or "" for _, x in rows)
    assert p.encode_pieces(table.limit(0)).count() == 0


def test_a_million_spaces():
    import sentencepiece

    own, lib = p.PieceEncoder(p.model_path()), sentencepiece.SentencePieceProcessor(model_file=p.model_path())
    for text in (" " * 1_000_000, "a" + " " * 1_000_001 + "b", "x" * 200_000):
        assert own.encode([text])[0].tolist() == lib.encode(text)


def test_pairs_as_merging_leaves_them():
    own = p.PieceEncoder(p.model_path())
    random.seed(9)
    some = [k for k, x in own.pieces.items() if p.MARK not in x[1:] and own.merged_alone(k)]
    inner = [k for k in some if own.pieces[k][0] != p.MARK]
    for _ in range(20_000):
        a, b = random.choice(some), random.choice(inner)
        assert own._pair(a, b) == (own.merged(own.pieces[a] + own.pieces[b]) == [own.pieces[a], own.pieces[b]])


def test_round_trip_is_encoding_and_decoding(spark):
    rows = [(1, None), (None, "a  b"), (2, ""), (1, "word " * 4_000), (3, "é執😀")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, n_tokens string")
    key = lambda r: str(tuple(r))
    assert sorted(p.round_trip(table, with_ids=True).collect(), key=key) == sorted(p.decode_pieces(p.encode_pieces(table), with_ids=True).collect(), key=key)
    assert p.round_trip(table.limit(0)).count() == 0


def test_unigram_viterbi_against_all_segmentations():
    own = p.PieceEncoder(p.model_path(), unigram=True)

    def best(word):
        if not word:
            return 0.0
        return max((own.scores[own.vocabulary[word[:k]]] if word[:k] in own.vocabulary else own.floor if k == 1 else -1e18) + best(word[k:]) for k in range(1, len(word) + 1))

    words = sorted(["▁the", "▁thing", "▁things", "▁tomorrow", "▁x執y"])
    for word, ids in zip(words, own.viterbi(words)):
        total = sum(own.scores[k] if k in own.scores else 0 for k in ids) + own.floor * (word == "▁x執y" and "執" not in own.vocabulary)
        assert abs(total - best(word)) < 1e-3
