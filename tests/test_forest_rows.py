"""a tree of the isolation forest is grown from rows of its own, also where rows repeat values."""

from pyspark.sql import functions as F

from telemara.operators import features
from telemara.plans import models


def leaves(tree):
    return 1 if len(tree) == 1 else leaves(tree[2]) + leaves(tree[3])


def test_the_query_grows_all_trees_of_the_reference_from_whole_samples(spark):
    copies = spark.range(12_000).select("id", *[F.sin((F.col("id") % 40) * (i + 1)).alias(f) for i, f in enumerate("abc")])
    model = features.iforest_fit(copies, list("abc"), trees=6, id="id")
    assert len(model["trees"]) == 6 and model["size"] == 256 and all(leaves(t) > 20 for t in model["trees"])
    assert models.TREES == 120
