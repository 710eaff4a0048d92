"""Operators 5 and 7 against brute force."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlog.llm import quotient, simhash


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, distance):
    """{index: smallest id reachable} by search over all pairs."""
    left, out = set(range(len(items))), {}
    while left:
        front = [left.pop()]
        found = list(front)
        while front:
            at = front.pop()
            near = {j for j in left if (items[at][1] ^ items[j][1]).bit_count() <= distance}
            left -= near
            front += near
            found += near
        least = min(items[i][0] for i in found)
        out |= {i: least for i in found}
    return out


def test_fingerprints(docs):
    found = sorted((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect())
    assert found == sorted((r.doc_id, plain_fingerprint(r.text)) for r in docs.collect())


def clustered(seed, n, flips):
    draw = np.random.default_rng(seed)
    centers = draw.integers(0, 2**63, 5)
    out = set()
    while len(out) < n:
        value = int(centers[draw.integers(5)])
        for b in draw.integers(0, 64, draw.integers(0, flips)):
            value ^= 1 << int(b)
        out.add(value)
    return sorted(out)


def check_components(spark, values, **options):
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    frame = spark.createDataFrame(signed, "fp long").repartition(4)
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, **options)).collect()}
    found = {fp: roots.get(fp, fp) for (fp,) in signed}
    items = [(s[0], v) for s, v in zip(signed, values, strict=True)]
    wanted = plain_components(items, 4)
    assert found == {items[i][0]: least for i, least in wanted.items()}


def test_components_equal_brute_force(spark):
    check_components(spark, clustered(1, 400, 8))


def test_split_buckets_lose_no_link(spark):
    check_components(spark, clustered(2, 300, 7), bucket=20)


def test_chain_is_one_component(spark):
    check_components(spark, [(1 << 4 * k) - 1 for k in range(17)])


@given(st.lists(st.integers(0, 63), min_size=0, max_size=4), st.integers(0, 2**64 - 1))
@settings(max_examples=200, deadline=None)
def test_close_pairs_share_a_choice_of_blocks(flips, value):
    other = value
    for b in flips:
        other ^= 1 << b
    same = [all((value >> low) % (1 << n) == (other >> low) % (1 << n) for low, n in [cut]) for cut in simhash._cuts(6)]
    assert sum(same) >= 2


def test_near_duplicates(spark, docs, no_docs):
    rows = docs.collect()
    items = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    wanted = plain_components(items, 4)
    found = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == sorted((d, f, wanted[i]) for i, (d, f) in enumerate(items))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_forest_links_every_member_once():
    fps = np.array(clustered(3, 200, 9), np.uint64)
    links = [(int(a), int(b)) for u, v in simhash.forest(fps, 4) for a, b in zip(u, v, strict=True)]
    assert len(links) < len(fps) and all((a ^ b).bit_count() <= 4 for a, b in links)


counts_of = st.dictionaries(st.integers(0, 2**60 - 1), st.integers(1, 5), max_size=60)


def build(counts):
    keys = np.array(sorted(counts), np.uint64)
    return quotient.CountingQuotientFilter.build(keys, np.array([counts[int(k)] for k in keys], np.uint64), 60)


def content(cqf):
    keys, counts = cqf.items()
    return dict(zip(keys.tolist(), counts.tolist(), strict=True))


@given(counts_of, counts_of)
@settings(max_examples=150, deadline=None)
def test_filters_merge_without_loss(left, right):
    a, b = build(left), build(right)
    assert content(a) == left
    assert content(quotient.CountingQuotientFilter.load(a.dump())) == left
    assert content(a.merge(b)) == {k: left.get(k, 0) + right.get(k, 0) for k in left | right}


def test_merged_filters_count_every_fingerprint(spark):
    values = [(int(v),) for v in np.random.default_rng(5).integers(-(2**63), 2**63, 500)]
    frame = spark.createDataFrame(values + values[:100] + values[:30], "fp long").repartition(5)
    table = quotient.filters(frame)
    found = {r.fp: r["count"] for r in quotient.repeated(table).collect()}
    assert found == {v: 3 if i < 30 else 2 for i, (v,) in enumerate(values[:100])}
    bitmap = quotient.marks(quotient.repeated(table))
    kept = {r.fp for r in quotient.marked(frame, bitmap).collect()}
    assert set(found) <= kept and len(kept) < 150


def test_exact_duplicates(docs, no_docs):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    wanted = sorted(
        (r.doc_id, max(own := groups[r.text or ""]), len(own), r.doc_id == max(own), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in rows
    )
    assert sorted(tuple(r) for r in quotient.duplicates(docs).collect()) == wanted
    assert quotient.duplicates(no_docs).count() == 0


def test_deduplicate_keeps_one_row_a_text(docs, no_docs):
    out = quotient.deduplicate(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text or "") for r in out.collect()]
    best = {}
    for r in docs.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(kept) == sorted((d, t) for t, d in best.items())
    assert quotient.deduplicate(no_docs).count() == 0


