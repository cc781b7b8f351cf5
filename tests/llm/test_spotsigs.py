import hashlib

from tesserae.llm import spotsigs


def check(df):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: -(r[0] if r[0] is not None else -1))
    got = spotsigs.op4(df).collect()
    assert len(got) == len(rows)
    ids = [r[0] for r in rows]
    own = {i: t for i, t in rows}
    nxt = {a[0]: b[1] for a, b in zip(rows, rows[1:] + rows[:1])}
    spots = spotsigs.Spotter()
    for r in got:
        if ids.count(r["doc_id"]) > 1:
            continue  # rows of one id follow a hash of their text
        t, n = own[r["doc_id"]], nxt[r["doc_id"]]
        assert r["n_chars"] == len(t) and r["fingerprint"] == spotsigs.write_fingerprint(spots.signatures(t))
        if ids.count(ids[(ids.index(r["doc_id"]) + 1) % len(ids)]) > 1:
            continue
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == spotsigs.write_fingerprint(spots.signatures(edited))
        sets = [set(spots.signatures(x).tolist()) for x in (t, edited, n)]
        jaccard = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
        assert abs(r["near_edited"] - jaccard(sets[0], sets[1])) < 1e-12 and abs(r["near_next"] - jaccard(sets[0], sets[2])) < 1e-12
    return got


def test_whole_table(small):
    got = check(small)
    assert sum(r["near_edited"] for r in got) > 20 * sum(r["near_next"] for r in got)


def test_edges(edge, empty, spark):
    check(edge)
    assert spotsigs.op4(empty).count() == 0
    one = spark.createDataFrame([(9, "the old house stands by the river bank")], "doc_id long, text string")
    assert [r["near_next"] for r in spotsigs.op4(one).collect()] == [1.0]


def test_matches_equal_brute_force(small):
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in spotsigs.spotsigs_matches(small).collect()}
    spots = spotsigs.Spotter()
    first: dict[str, int] = {}
    for r in sorted(small.collect(), key=lambda r: r["doc_id"]):
        first.setdefault(spotsigs.write_fingerprint(spots.signatures(r["text"] or "")), r["doc_id"])
    sets = {i: spotsigs.read_fingerprint(f) for f, i in first.items() if not f.startswith("0:")}
    want = {(a, b): j for a in sets for b in sets if a < b and (j := spotsigs.pruned_jaccard(sets[a], sets[b], 0.8)) >= 0.8}
    assert got == want


def test_members_name_the_representatives_of_matches(small, edge, empty):
    members = {r["id"]: r["rep"] for r in spotsigs.spotsigs_members(small).collect()}
    spots = spotsigs.Spotter()
    prints = {r["doc_id"]: spotsigs.write_fingerprint(spots.signatures(r["text"] or "")) for r in small.collect()}
    assert members == {i: min(j for j in prints if prints[j] == f) for i, f in prints.items()}
    assert len(set(members.values())) < len(members)
    assert {x for r in spotsigs.spotsigs_matches(small).collect() for x in (r["id_a"], r["id_b"])} <= set(members.values())
    assert spotsigs.spotsigs_members(edge).count() == edge.count() and spotsigs.spotsigs_members(empty).count() == 0
