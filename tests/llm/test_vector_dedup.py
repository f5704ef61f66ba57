"""Near-duplicate embeddings against all pairs in double precision."""

import numpy as np
import pytest

from gristmill.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int, v string, low long"


def plain(rows, threshold=0.95):
    ok, unit = [], []
    for k, (i, v, *_) in enumerate(rows):
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        x /= np.abs(x).max()
        ok.append(k)
        unit.append(x / np.linalg.norm(x))
    root, links = {k: rows[k][0] for k in ok}, dict.fromkeys(range(len(rows)), 0)
    pairs = []
    for a in range(len(ok)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                pairs.append((ok[a], ok[b]))
                links[ok[a]] += 1
                links[ok[b]] += 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(root[a], root[b])
            moved |= root[a] != root[b]
            root[a] = root[b] = low
    return sorted(((r[0], links[k], root.get(k, r[0]), r[0] is not None and r[0] == root.get(k, r[0])) for k, r in enumerate(rows)), key=repr)


def vectors(seed=11, dims=48):
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.normal(size=(150, dims))
    out = [*base]
    for x in base[:30]:  # copies at any distance around the threshold, and chains of them
        for _ in range(4):
            x = x + rng.normal(size=dims) * rng.uniform(0.02, 0.4)
            out.append(x * rng.uniform(0.1, 50))
    hot = rng.normal(size=dims)
    out += [hot + rng.normal(size=dims) * 0.05 for _ in range(120)] + [hot] * 40
    rows = [(int(i), [float(a) for a in np.float32(x)]) for i, x in zip(rng.permutation(len(out)) * 3 - 50, out, strict=True)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * dims), (9004, [1.0, None] + [0.0] * (dims - 2)), (9005, [float("nan")] + [1.0] * (dims - 1)), (9006, [float("inf")] * dims), (None, rows[0][1]), (None, None)]
    rows += [(9007, [1.0]), (9008, [-2.0]), (9009, [3.0]), (9010, [1.0, 0.3]), (9011, [1.0, 0.31]), (9012, [1.0, 0.0]), rows[3], (rows[4][0], rows[5][1]), (9013, [3e38] * dims), (9014, [1e-30] * dims)]
    return [(i, v, 0, "x", 1) for i, v in rows]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_links_are_those_of_all_pairs(spark, chunk):
    rows = vectors()
    out = V.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = plain(rows)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert any(r[1] > 100 for r in want) and any(0 < r[1] < 4 for r in want)


def test_no_rows_and_one_row(spark, tmp_path):
    for k, rows in enumerate(([], [(5, [1.0, 2.0], 0, "x", 1)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert [tuple(r) for r in V.op11_vector_dedup(spark, f"{tmp_path}/{k}").collect()] == [(r[0], 0, r[0], True) for r in rows]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(400, 64))
    y = x + rng.normal(size=x.shape) * 0.3
    true = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    both = np.vstack([x, y])
    code, sketch, _ = V.codes(both, 4, 8)
    head = np.ascontiguousarray(sketch[:, :12]).view("<f4")
    levels = np.stack([sketch[:, 12:] >> 4, sketch[:, 12:] & 15], axis=2).reshape(800, -1)[:, :64]
    turned = head[:, 1:2] + head[:, 2:3] * levels
    signs = np.unpackbits(code, axis=1)[:, :64] * 2.0 - 1
    estimate = (signs[:400] * turned[400:]).sum(1) / 8 / head[:400, 0]
    assert abs((estimate - true).mean()) < 0.01
    beside = np.sqrt(1 - head[:400, 0] ** 2) / head[:400, 0] * np.sqrt(1 - true**2)
    assert (np.abs(estimate - true) <= V.EPSILON * (beside / np.sqrt(63) + head[400:, 2] / 2 / head[:400, 0])).all()


def test_bands_grow_slowly_and_miss_little():
    for n in (0, 1, 200, 10**5, 10**9):
        width, bands = V.bands_for(n)
        agree = (1 - np.arccos(V.THRESHOLD) / np.pi) ** width
        assert (1 - agree) ** bands <= V.MISS * 1.001 and bands < 250
