import numpy as np

from twinlens.llm import vectors


def test_pairs_that_the_first_passes_miss_are_found(spark):
    """Borderline pairs of one label against brute force, with first passes that miss many of them."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(1500, 64))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.94 * base + np.sqrt(1 - 0.94**2) * other
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(df, passes=2, followers=8).collect()}
    assert got == {i: (1, i % 1500) for i in range(3000)}
