import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

from tesserae.llm import transducer


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=transducer.default_model())


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(transducer.default_model())


def test_whole_table(small, library):
    got = {r["doc_id"]: r for r in transducer.op9(small).collect()}
    for r in small.collect():
        ids = library.encode(r["text"])
        g = got[r["doc_id"]]
        assert (g["n_ids"], g["ids_crc32"], g["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4")), True)
        assert g["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_random_texts(library, machine):
    rnd = random.Random(7)
    letters = "aeinrst TheÉßéx.,  \n\t0129▁½ﬁ中한文😀<s>\x00"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [" " * a + "x" + " " * b for a in range(40) for b in (0, 1, 7, 16, 33)]
    for t in texts:
        ids = machine.encode(t).tolist()
        assert ids == library.encode(t)
        assert machine.decode(ids) == t.replace("▁", " ")


def test_edges(edge, empty):
    assert transducer.op9(edge).count() == edge.count() and transducer.op9(empty).count() == 0
    back = transducer.decode(transducer.encode(edge, keep=["doc_id"]))
    texts = lambda df: sorted(r["text"] or "" for r in df.collect())
    assert texts(back) == texts(edge)


def test_bad_bytes_decode_to_marks(machine):
    assert machine.decode([machine.bytes[0xFF], machine.bytes[0x41]]) == "�A"


def test_unigram_path_is_the_cheapest(machine):
    other = object.__new__(transducer.Transducer)
    other.kind, other.longest = transducer.UNIGRAM, 3
    other.ids = {"a": 0, "b": 1, "ab": 2, "abc": 3, "c": 4}
    other.score = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -4.0, "c": -1.0}
    assert other._shortest("abc") == ["ab", "c"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(fields):
    return b"".join(varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields)


def variant(path, *, rule=None, kind=None, keep_bytes=True, **flags):
    """The public model with another normaliser, segmentation or no byte fallback, as a file."""
    with open(transducer.default_model(), "rb") as f:
        top = list(transducer._fields(f.read()))
    spec = {3: 1, 4: 1, 5: 1}
    if rule:
        spec |= dict(transducer._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()))
    spec |= {3: int(flags.get("prefix", True)), 4: int(flags.get("squeeze", True))}
    out = []
    for rank, (k, v) in enumerate(top):
        if k == 1 and kind == transducer.UNIGRAM and (piece := dict(transducer._fields(v))).get(3, 1) == 1:
            # log probabilities in place of merge ranks; none twice, so that no two paths tie
            v = message([(1, piece[1])]) + varint(2 << 3 | 5) + struct.pack("<f", -3 - rank**0.5 / 17)
        if k == 1 and not keep_bytes and dict(transducer._fields(v)).get(3) == 6:
            continue
        if k == 2:
            held = [(f, x) for f, x in transducer._fields(v) if f not in (3, 35) and not (f in (41, 42, 43))]
            v = message([*[(f, x) for f, x in held if isinstance(x, (int, bytes)) and f < 10 and f != 10], (3, kind or transducer.BPE), (35, int(keep_bytes))])
        if k == 3:
            v = message([(f, x) for f, x in sorted(spec.items()) if isinstance(x, (int, bytes))])
        out.append((k, v))
    with open(path, "wb") as f:
        for k, v in out:
            f.write(message([(k, v)]))
    return str(path)


@pytest.mark.parametrize(
    "options",
    [{"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc_cf", "squeeze": False}, {"rule": "identity", "prefix": False}, {"rule": "nfkc", "kind": transducer.UNIGRAM}, {"rule": "nmt_nfkc", "kind": transducer.UNIGRAM, "keep_bytes": False}],
    ids=lambda o: "-".join(f"{k}={v}" for k, v in o.items()),
)
def test_normalisers_and_kinds_equal_the_library(tmp_path, options):
    path = variant(tmp_path / "m.model", **options)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), transducer.Transducer(path)
    rnd = random.Random(11)
    letters = "aeinrst TheÉßéx.,  \n\t0129½ﬁ①Ａ中한e\u0301文ガ\u3000\u200b\xa0😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    texts += ["", " ", "   ", "  a  b  ", "ﬁne ﬁ", "A\u030a", "the quick  brown fox", "\u3000x\u3000"]
    for t in texts:
        ids = machine.encode(t).tolist()
        assert ids == library.encode(t), t
        assert machine.decode(ids) == library.decode(ids), t


def test_what_is_not_supported(tmp_path):
    with open(transducer.default_model(), "rb") as f:
        top = list(transducer._fields(f.read()))
    odd = [(k, message([(f, x) for f, x in transducer._fields(v) if f != 3 and isinstance(x, bytes)][:1] + [(3, 4)]) if k == 1 and i == 300 else v) for i, (k, v) in enumerate(top)]
    (tmp_path / "m").write_bytes(b"".join(message([x]) for x in odd))
    with pytest.raises(ValueError, match="user-defined"):
        transducer.Transducer(str(tmp_path / "m"))
