import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tesserae.llm import packing


def check(df, **options):
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = df.collect()
    want = sorted((r["doc_id"], np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for r in rows if r["doc_id"] is not None)
    got = packing.pack(df, with_ids=True, **options).collect()
    pieces = sorted((r for r in got if r["doc_id"] is not None), key=lambda r: (r["sequence_id"], r["offset"]))
    for r in got:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4")) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
    texts = []
    for r in pieces:  # sequence order is document order, so a document's pieces follow each other
        if r["start"] == 0:
            texts.append((r["doc_id"], [], r["doc_tokens"]))
        assert r["doc_id"] == texts[-1][0] and r["start"] == len(texts[-1][1])
        texts[-1][1].extend(r["ids"])
    assert all(len(ids) == n for _, ids, n in texts)
    assert sorted((i, np.array(ids, dtype="<u4").tobytes()) for i, ids, _ in texts) == want
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at == r["sequence_length"] <= 4096
    return got


def test_whole_table(small):
    got = check(small)
    length = {r["sequence_id"]: r["sequence_length"] for r in got}
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in length.values())
    assert padding < 0.02 * sum(length.values())


@pytest.mark.parametrize("block_tokens", [1, 6000, 50_000])
def test_many_blocks(small, block_tokens):
    """Blocks that are packed before the stream ends: whole pieces, no gaps, little padding."""
    got = check(small.coalesce(1), block_tokens=block_tokens)
    length = {r["sequence_id"]: r["sequence_length"] for r in got}
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in length.values())
    assert padding < 0.05 * sum(length.values())


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_edges(edge, empty):
    check(edge)
    check(edge, block_tokens=2000)
    assert packing.op3(empty).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    at = np.unique(np.cumsum(rng.integers(1, 9, 40)))
    penalty = rng.integers(0, 6, len(at)).astype(float)
    cuts = packing.choose_cuts(at, penalty, 16, final=True)
    place = {int(p): c for p, c in zip(at, penalty)}
    assert cuts[-1] == at[-1] and all(0 < b - a <= 16 for a, b in zip([0, *cuts], cuts))
    assert cost_of(cuts, place, 16) == pytest.approx(least_cost(at.tolist(), penalty.tolist(), 16))


def cost_of(cuts, place, window):
    """What cuts cost: padded windows that end at candidates, then windows of falling powers of two."""
    found, spent, last = [], 0.0, 0
    for k in range(len(cuts) + 1):
        rest = [b - a for a, b in zip([last, *cuts[k:]], cuts[k:])]
        if all(n & (n - 1) == 0 for n in rest) and rest == sorted(set(rest), reverse=True):
            found.append(spent + max(len(rest) - 1, 0) * packing.INSIDE)
        if k == len(cuts) or cuts[k] not in place:
            break
        spent, last = spent + place[cuts[k]] + window - (cuts[k] - last), cuts[k]
    return min(found)


def least_cost(at, penalty, window):
    """The least cost over all choices."""
    best = best_costs(at, penalty, window)
    tails = [c + ((at[-1] - i).bit_count() - 1) * packing.INSIDE for i, c in best.items() if 0 < at[-1] - i <= window]
    return min([*tails, best.get(at[-1], float("inf"))])


def best_costs(at, penalty, window):
    """The least cost of padded windows that end at each candidate, over all choices."""
    best = {0: 0.0}
    for j, p in enumerate(at):
        found = [best[i] + penalty[j] + window - (p - i) for i in best if p - window <= i < p]
        if found:
            best[p] = min(found)
    return best


def test_words_equal_the_tokenizer():
    words = packing.WordTokenizer(packing.default_tokenizer(), limit=20)
    texts = ["It's 5,000 İstanbul ΑΣ ﬁne é a\x1cb <|endoftext|>x", "", " \x85   ", "naïve Größe!!! ..., 'tis x's", "中文한글 😀 ½²", "The the THE the. THE?"]
    for t in [*texts, *texts]:
        assert words.encode([t])[0][0].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids
