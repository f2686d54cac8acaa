"""SimHash and lattice near-dedup against brute force; components on hard graphs."""

import random

import numpy as np
import pytest
import xxhash
from helpers import Groups, docs, no_docs, rows, rows_of  # noqa: F401

from cxpulse.llm import lattice
from cxpulse.llm.components import components
from cxpulse.llm.simhash import drop_near_copies, fingerprint, fingerprint_links, simhash_classes


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_its_definition(rows):
    for r in rows[:40] + rows[-8:]:
        t = (r[1] or "")[:4000]
        assert fingerprint(t.encode()) == plain_fingerprint(t)
    assert fingerprint("ÀB c d E".encode()) == plain_fingerprint("Àb c d e")  # only A-Z, only ASCII space


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 4])
def test_links_are_complete_and_once(spark, max_bits):
    rng = random.Random(max_bits)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(0, max_bits + 1)):
                y ^= 1 << b
            fps.add(y)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = rows_of(fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits))
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits}
    assert set(got) == want and all(n == 1 for n in got.values())


def test_simhash_classes(spark, rows, docs, no_docs):
    got = rows_of(simhash_classes(docs))
    fps = [plain_fingerprint(r[1]) if len(r[1] or "") < 20_000 else fingerprint((r[1] or "").encode()) for r in rows]
    g = Groups()
    for i, a in enumerate(fps):
        g.find(a)
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                g.join(a, b)
    first = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            first[g.find(f)] = min(r[0], first.get(g.find(f), r[0]))
    want = {}
    for r, f in zip(rows, fps):
        key = (r[0], f - (1 << 64) if f >> 63 else f, first.get(g.find(f)))
        want[key] = want.get(key, 0) + 1
    assert got == want
    assert simhash_classes(no_docs).count() == 0
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {g.find(f) for f in fps}
    assert len(ids) == len(classes) and {i for i in ids if i is not None} == set(first.values())
    assert drop_near_copies(no_docs).count() == 0


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(300)],
    [(0, i) for i in range(1, 200)] + [(i, 999) for i in range(200)],
    [(a, b) for a in range(20) for b in range(20)] + [(100, 100)],
    [(random.Random(i).randint(0, 400), random.Random(i + 1000).randint(0, 400)) for i in range(300)],
])
def test_components(spark, edges):
    g = Groups()
    for a, b in edges:
        g.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    pairs = {(g.find(n), r) for n, r in got.items()}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 3
    near = lattice.decode_e8(x)
    doubled = np.rint(near * 2)
    assert (np.abs(doubled % 2).sum(1) % 8 == 0).all() and (np.rint(near.sum(1)) % 2 == 0).all()
    best = ((x - near) ** 2).sum(1)
    for v in lattice.shortest():
        assert (((x - near - v) ** 2).sum(1) >= best - 1e-9).all()
    assert (((x - near) ** 2).sum(1) <= 1 + 1e-9).all()  # covering radius


def vectors(seed=3, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(150):
        x = rng.normal(size=dim)
        x /= np.linalg.norm(x)
        out.append(x)
        for _ in range(rng.integers(0, 4)):
            z = rng.normal(size=dim)
            z -= z @ x * x
            c = rng.uniform(0.86, 1.0)
            out.append(c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    return out


def test_lattice_links_against_brute_force(spark):
    vs = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(vs)]
    rows += [(1000 + i, vs[0].tolist()) for i in range(40)] + [(2000, (vs[1] * 3).tolist())]  # copies, scaled copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [None] + [1.0] * 63),
             (3005, [1.0, 0.0]), (3006, [1.0, 1e-3]), (None, vs[2].tolist()), (5, vs[5].tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    got = lattice.near_dedup(df).collect()
    assert len(got) == len(rows)

    def ok(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [i for i, r in enumerate(rows) if ok(r[1])]
    want = {}
    for i in good:
        a = np.array(rows[i][1])
        want[i] = sum(1 for j in good if i != j and len(rows[j][1]) == len(a)
                      and a @ np.array(rows[j][1]) / (np.linalg.norm(a) * np.linalg.norm(rows[j][1])) >= 0.9)
    found, real = sum(r.n_links for r in got), sum(want.values())
    assert 0.97 * real <= found <= real
    links = Groups()
    for i in good:
        a = np.array(rows[i][1])
        for j in good:
            if j < i and len(rows[j][1]) == len(a) and a @ np.array(rows[j][1]) >= 0.9 * np.linalg.norm(a) * np.linalg.norm(rows[j][1]):
                links.join(rows[i][0] if rows[i][0] is not None else 10 ** 6, rows[j][0] if rows[j][0] is not None else 10 ** 6)
    by_id = {r.vec_id: r for r in got if r.vec_id is not None}
    assert by_id[1000].component_id == 0 and not by_id[1000].kept and by_id[1000].n_links >= 40
    assert by_id[2000].component_id == by_id[1].component_id == links.find(1)
    assert by_id[3005].component_id == by_id[3006].component_id == 3005
    assert sum(links.find(i) == r.component_id for i, r in by_id.items()) >= 0.98 * len(by_id)
    for i in (3000, 3001, 3002, 3003, 3004):
        assert by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept
    for r in got:
        if r.vec_id is not None:
            assert r.kept == (r.vec_id == r.component_id)
    assert lattice.near_dedup(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    args = (lattice.TABLES, lattice.BLOCKS, lattice.PROBES, lattice.SCALE, lattice.SEED)
    (hx, px, sx), (hy, py, sy) = lattice.cells(x, *args), lattice.cells(y, *args)
    met = ((py == hx[:, :, None]).any(2) | (px == hy[:, :, None]).any(2)).any(1)
    near = np.unpackbits((sx ^ sy).view(np.uint8).reshape(-1, 8), axis=1).sum(1) <= lattice.SIGNS
    assert (met & near).mean() >= 0.97


def test_lattice_links_at_any_magnitude(spark):
    from cxpulse.llm.lattice import near_dedup

    rng = np.random.default_rng(7)
    rows, want = [], {}
    scales = [1.0, 1e-300, 1e-170, 1e170, 1e300, 3.7]
    base = [rng.normal(size=16) for _ in range(3)]
    for g, x in enumerate(base):
        x = x / np.abs(x).max()
        for i, scale in enumerate(scales):
            rows.append((100 * g + i, (x * scale).tolist()))
        noisy = x + 0.05 * rng.normal(size=16)
        rows.append((100 * g + 50, (noisy / np.abs(noisy).max() * 1e300).tolist()))
    far = base[0] / np.linalg.norm(base[0])
    other = rng.normal(size=16)
    other -= far * (far @ other)
    other /= np.linalg.norm(other)
    for i, cosine in enumerate((0.85, 0.80)):
        v = cosine * far + np.sqrt(1 - cosine ** 2) * other
        rows.append((900 + i, (v * 1e170).tolist()))
    rows += [(950, [1e300] + [1e-300] * 15), (951, [5e-324] + [0.0] * 15), (952, [0.0] * 16), (953, [float("inf")] * 16), (None, (far * 1e-300).tolist())]
    units = []
    for _, v in rows:
        x = np.array(v)
        ok = np.isfinite(x).all() and x.any()
        x = x / np.abs(x).max() if ok else x * np.nan
        units.append(x / np.linalg.norm(x) if ok else None)
    links = {i: sum(1 for j, y in enumerate(units) if j != i and x is not None and y is not None and x @ y >= 0.9) for i, x in enumerate(units)}
    got = near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), "vec_id", "embedding")
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == {rows[i][0]: n for i, n in links.items()}
