"""Alignment against the libraries on whole texts and all pairs of tokens."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_a())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_b())
    letters = {chr(c): c for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    rest = [c for c in range(256) if c not in letters.values()]
    letters |= {chr(256 + i): c for i, c in enumerate(rest)}

    def encode(text):
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        raw = [bytes(letters[c] for c in t) for t in x.tokens]
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return (x.ids, raw), (y, list(map(piece, y)))

    return encode


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows, encode):
    """By all pairs of tokens near each other; the groups by the set of common ends."""
    held, counts = [], Counter()
    for doc_id, text in rows:
        (ia, ta), (ib, tb) = encode(text) if text else (([], []), ([], []))
        want = (" " + text).encode() if text else b""
        if b"".join(ta) != want or b"".join(tb) != want:
            ia, ta, ib, tb = [], [], [], []
        sa, sb, links, j = spans(ta), spans(tb), [], 0
        for i, (s, e) in enumerate(sa):
            while j < len(sb) and sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                if max(s, sb[k][0]) < min(e, sb[k][1]):
                    links.append((ia[i], ib[k]))
                k += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, lo = [], 0
        for end in ends:
            pick = lambda ids, sp: ",".join(str(n) for n, (s, e) in zip(ids, sp) if lo <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{pick(ia, sa)}|{pick(ib, sb)}" if len(sa) < 3000 else None)
            lo = end
        counts.update(set(links))
        held.append((doc_id, len(ia), len(ib), links, groups))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, na, nb, links, groups in held:
        digest = "" if not groups else "long" if groups[0] is None else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, na, nb, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out


def same(df, want):
    got = sorted(map(str, (tuple(r) for r in df.collect())))
    rows = sorted(map(str, want))
    if any("'long'" in r for r in rows):  # digests of very long texts are not spelled out by brute force
        drop = lambda r: r.rsplit(",", 1)[0] if int(r.split(", ")[1]) >= 3000 else r
        got, rows = list(map(drop, got)), list(map(drop, rows))
    assert got == rows


def test_whole_table(small, encoders):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    want = brute(rows, encoders)
    same(alignment.op11(small), want)
    same(alignment.align(small.repartition(3), block_bytes=5000), want)


def test_edges(edge, empty, encoders):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    same(alignment.op11(edge), brute(rows, encoders))
    assert alignment.op11(empty).count() == 0


ODD = ["  two  spaces ", "\ttab\tand\nline\r\nends;\r\n", "a\r\rb \r c", " \x1cunit\x1d!\x1cx", "nb\xa0sp em　wide line", "mark ▁ in ▁text▁", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'M", "日本語とemoji 😀👍🏽 ﬁ é é", "\x00 nul \x07", " ", "\n", "\n\n lead", "trail \n", "…—“q”", "x" * 700 + " " * 40 + "y", "1234567 3.14%%% ((([[]"]


def test_odd_texts(spark, encoders):
    rng = np.random.default_rng(4)
    letters = list("ab .'\n\r\t\xa0é日▁\x1c\x85　😀<>0x1s") + ["  ", " the", "\n\n"]
    rows = list(enumerate(ODD + ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(400)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(alignment.align(df), brute(rows, encoders))


def test_overlaps():
    a, b, closes = alignment.overlaps(np.array([2, 5, 6]), np.array([1, 3, 5, 6]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3)] and closes.tolist() == [False, False, True, True]
    none = alignment.overlaps(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    assert [len(x) for x in none] == [0, 0, 0]


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        alignment.ByteTokenizer(public_tokenizers.path("word_bpe_49k.json"))
