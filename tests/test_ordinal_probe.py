import numpy as np

from grovekit.operators import models
from grovekit.plans import catalog


def test_probe_uses_all_components(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 64)), rng.integers(0, 4, 200)
    x[:, 63] = y  # only the last component tells the label
    df = spark.createDataFrame([(i, int(k), [float(c) for c in v]) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id bigint, label int, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    m = models.gram_vector(df, "embedding", "label", 64)
    z = np.column_stack([np.ones(200), x.astype(np.float32), y])
    assert np.allclose(m, z.T @ z)
    assert catalog.build().queries["mlx_13_ordinal_probe"](spark, str(tmp_path)).first().hits == 200
