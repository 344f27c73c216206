import random

import numpy as np
import pytest
import sentencepiece

from gridloom.llm import piece_fst as fst_of
from gridloom.llm.piece_fst import MODEL, PieceEncoder, decode_ids, encode_ids, round_trip

POOL = [" "] * 30 + list("abcdefthein") * 6 + ["\n", "\t", "é", "日", "ȝ", "🤣", "▁", "ﬁ", "ThE", "the", "ing", "  ", "    ", "\x00", ".", "1", "23", "ß", "я"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder()


def test_same_ids_as_the_library(library, encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += [" " * n for n in range(1, 40)] + [" " * n + "two" for n in range(40)] + ["b" * 200, "日" * 100, "", "internationalisation " * 20]
    got = encoder.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]


def test_store_may_be_emptied(library):
    small = PieceEncoder(kept=3)
    for t in ["a b c d e", "f g h i j", "a b c", "k l m n o p"]:
        assert small.encode([t.encode()])[0].tolist() == library.encode(t)


def test_decoding_is_exact(encoder):
    rng = random.Random(5)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(50))) for _ in range(300)]
    for t, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert encoder.fst.decode(ids.astype(np.int64)) == t.replace("▁", " ").encode()


def test_pairs_are_free_or_forbidden(encoder):
    fst = encoder.fst
    pair = lambda a, b: (fst.id[a] + 1) << 32 | fst.id[b]
    assert not fst.fits(pair("t", "he")) and fst.fits(pair(" the", " t"))


def model(path, pieces, kind, prefix=True):
    """A model file with an identity normaliser; pieces: (text, score)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, True
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", prefix, False, True
    m.pieces.add(piece="<unk>", score=0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=proto.ModelProto.SentencePiece.BYTE)
    for text, score in pieces:
        m.pieces.add(piece=text.replace(" ", "▁"), score=score)
    path.write_bytes(m.SerializeToString())
    return str(path)


#: None is another one twice: b + bb and bb + b would weigh the same, and rounding decide.
PIECES = [" ", "a", "b", "c", "ab", "bc", "abc", " a", " ab", "ca", "cab", "é", "éa", "xy"]


@pytest.mark.parametrize("seed, prefix", [(1, True), (2, False)])
def test_unigram_models(tmp_path, seed, prefix):
    rng = random.Random(seed)
    path = model(tmp_path / "m", [(p, -rng.uniform(1, 9)) for p in PIECES], 1, prefix)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceEncoder(path)
    texts = ["".join(rng.choice("aaabbbccc  éx日▁y") for _ in range(rng.randrange(30))) for _ in range(400)] + ["ab" * 200, "", " "]
    got = own.encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [library.encode(t) for t in texts]


def test_batches_equal_the_explicit_composition(tmp_path):
    """The path of the text's acceptor composed with normaliser, pieces and bytes, one transducer after the other."""
    rng = random.Random(3)
    own = PieceEncoder(model(tmp_path / "m", [(p, -rng.uniform(1, 9)) for p in PIECES], 1)).fst
    weights = {x: (i, -own.score[x]) for x, i in own.id.items()}
    lexicon = fst_of.pieces_or_bytes(weights, own.fallback)
    for _ in range(150):
        text = "".join(rng.choice("abc é日▁xy") for _ in range(rng.randrange(1, 12)))
        whole = fst_of.compose(fst_of.compose(fst_of.chain(text), fst_of.normaliser(True)), lexicon)
        ids = [x - fst_of.PIECE for x in fst_of.shortest_path(whole) if x >= fst_of.PIECE]
        got = own.shortest([" " + text])[0].tolist()
        assert [i for i in got if i in own.text] == ids
        assert own.decode(np.array(got)).decode() == text.replace("▁", " ")


def test_tables(docs_of, library):
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "word " * 20_000), (5, "ȝ"), (5, "ȝ"), (None, "x▁y")]
    got = round_trip(docs_of(rows)).collect()
    assert sorted(((repr(r["doc_id"]), r["n_pieces"]) for r in got)) == sorted((repr(i), len(library.encode(t or ""))) for i, t in rows)
    assert all(r["round_trip"] for r in got) and {r["n_byte_pieces"] for r in got if r["doc_id"] == 5} == {2}
    ids = encode_ids(docs_of(rows))
    assert {repr(r["doc_id"]): r["text"] for r in decode_ids(ids).collect()}["3"] == "a\nb"
    assert round_trip(docs_of([])).count() == 0
