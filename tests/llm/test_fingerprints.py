import hashlib

from placewright.llm.fingerprints import BITS, RADIUS, Fingerprinter, fingerprint_documents, likeness, near_counts
from tests.llm.helpers import documents, odd_rows


def test_odd_rows_and_edits(spark):
    rows = odd_rows()
    got = fingerprint_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if [x[0] for x in rows].count(r[0]) == 1]
    texts = [t or "" for _, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0])]
    make = Fingerprinter()
    for r in got:
        if r.doc_id in {i for i, _, _ in unique} and r.doc_id not in (4, 5, 6):
            text = next(t or "" for i, t, _ in rows if i == r.doc_id)
            after = next((t or "" for i, t, _ in sorted((x for x in rows if x[0] is not None)) if i > r.doc_id), None) if r.doc_id != 10 else None
            assert r.n_chars == len(text) and r.fingerprint == make(text).hex()
            if after is not None and r.doc_id != 3:
                edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
                assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
                assert r.near_edited == likeness(make(text), make(edited)) and r.near_next == likeness(make(text), make(after))
    assert len(texts) == len(got)
    assert fingerprint_documents(documents(spark, rows).limit(0)).count() == 0


def test_chain_over_many_partitions(spark):
    rows = [(i * 3, " ".join(f"w{(i * j) % 91}" for j in range(i % 50)), "s") for i in range(300)]
    got = {r.doc_id: r for r in fingerprint_documents(documents(spark, rows).repartition(7)).collect()}
    assert len(got) == 300
    for k, (i, text, _) in enumerate(rows):
        after = rows[(k + 1) % 300][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_single_document_is_its_own_next(spark):
    row = fingerprint_documents(documents(spark, [(5, "a b c d", "s")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and row.near_next == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(BITS) for _ in range(6)]
    prints = []
    for i in range(300):
        value = rng.choice(base)
        for _ in range(rng.randint(0, RADIUS + 2)):
            value ^= 1 << rng.randrange(BITS)
        prints.append((i, f"{value:0{BITS // 4}x}"))
    got = {r.doc_id: r.n_near for r in near_counts(spark.createDataFrame(prints, "doc_id long, fingerprint string")).collect()}
    for i, a in prints:
        if i % 20 == 0:
            assert got[i] == sum((int(a, 16) ^ int(b, 16)).bit_count() <= RADIUS for _, b in prints) - 1
    assert len(got) == 15


def test_rows_of_one_id_keep_their_own_counts(spark):
    rows = [(20, "a b c d e f", "s"), (20, "u v w x y z", "s"), (21, "a b c d e f", "s"), (22, "a b c d e f", "s"), (23, "other words here", "s")]
    got = sorted((r.doc_id, r.fingerprint, r.n_near) for r in fingerprint_documents(documents(spark, rows)).collect())
    make = Fingerprinter()
    assert got == sorted([(i, make(t).hex(), None if i % 20 else 2 * (t[0] == "a")) for i, t, _ in rows], key=lambda r: r[:2])
