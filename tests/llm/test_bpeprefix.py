import hashlib
import random
import struct

import pytest
import tiktoken

from melisma.llm import bpeprefix as B

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoder():
    path, pattern = B.default_vocabulary()
    with open(path, "rb") as f:
        return B.Encoder(f.read(), pattern)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=B.default_vocabulary()[1], mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def ids(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def texts(rng, n):
    tokens = None
    for i in range(n):
        kind = i % 4
        if kind == 0:
            yield "".join(rng.choice(" aeiounthrs'dl1\n\t.") for _ in range(rng.randint(0, 40)))
        elif kind == 1:
            points = [rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x370, 0x52F), rng.randint(0x4E00, 0x4F00), rng.randint(0x1F300, 0x1F6FF), rng.randint(0xE000, 0x10FFFF), 0x1C, 0x85, 0x558, 0x208F, 0x3000]) for _ in range(rng.randint(1, 25))]
            yield "".join(map(chr, points))
        elif kind == 2:
            tokens = tokens or [b" the", b"ing", b"tion", "é".encode(), b"\xc3", b"\xa9", b" and", b"'s", b"  ", b"00"]
            yield b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 12))).decode("utf-8", "replace")
        else:
            yield "".join(rng.choice(["the", "con", "tion", "ing", "ed", " "]) for _ in range(rng.randint(1, 30)))


def test_equals_the_library_and_decodes_to_the_text(encoder, library):
    for text in texts(random.Random(3), 4000):
        got = encoder.encode(text)
        assert ids(got) == library.encode_ordinary(text)
        assert B.decode_ids(got, encoder.vocabulary.tokens) == text.encode()


def test_characters_that_lately_came_into_unicode(encoder, library):
    for point in [*range(0x500, 0x600), *range(0x870, 0x8A0), *range(0x1C80, 0x1CA0), *range(0x2080, 0x20A0), *range(0x2FFF0, 0x30010)]:
        text = f"ab{chr(point)}1{chr(point)} !{chr(point)}"
        assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_every_prefix_of_a_piece_has_its_encoding(encoder, library):
    piece = b"internationalisierungsgeschwindigkeiten"
    table = B.Prefixes(encoder.vocabulary, piece)
    for i in range(1, len(piece) + 1):
        assert encoder.vocabulary.read_back(table.last[: i + 1]) == library.encode_ordinary(piece[:i].decode())


def test_a_very_long_piece(encoder, library):
    text = "ab" * 50_000 + " " * 5000 + "é" * 3000
    assert ids(encoder.encode(text)) == library.encode_ordinary(text)


def test_appends_and_edits_make_only_what_is_near_anew(encoder, library):
    rng = random.Random(4)
    for _ in range(400):
        word = "".join(rng.choice("aethinos") for _ in range(rng.randint(1, 150)))
        a = rng.randint(0, len(word))
        b, new = rng.randint(a, min(len(word), a + 9)), "".join(rng.choice("aethin") for _ in range(rng.randint(0, 9)))
        table = B.Prefixes(encoder.vocabulary, word.encode())
        table.replace(a, b, new.encode())
        table.append(b"ing")
        assert table.last == B.Prefixes(encoder.vocabulary, (word[:a] + new + word[b:] + "ing").encode()).last
        edited = B.Edited(encoder, "".join(rng.choice(" aeth'slrd1  \n.") for _ in range(rng.randint(0, 60))))
        for _ in range(4):
            a = rng.randint(0, len(edited.text))
            edited.edit(a, rng.randint(a, min(len(edited.text), a + 5)), "".join(rng.choice(" aet'srl1 \n") for _ in range(rng.randint(0, 5))))
            edited.append(rng.choice(["s", " ", "'"]))
            assert ids(edited.ids()) == library.encode_ordinary(edited.text)
    long = B.Edited(encoder, "some words go here " * 2000)
    assert long.edit(20_000, 20_003, "xyz") < 10
    table = B.Prefixes(encoder.vocabulary, b"mississippi" * 1000)
    assert table.replace(5000, 5001, b"q") < 200


def test_rows_of_any_kind(spark, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 70_000 + " é一")]
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, ids string, value binary")
    got = B.decode(B.encode(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r["row"]["row"]["text"] or ""
        assert ids(r["row"]["ids"]) == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert B.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_the_library(spark, library):
    got = {r["doc_id"]: r for r in B.op12_prefix_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
