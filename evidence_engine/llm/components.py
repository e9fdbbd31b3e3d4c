"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, comp): comp is the smallest node of the component.

    Labels spread to neighbours and then jump to the label's own label, so the number of rounds
    follows the logarithm of a component's width. Each round is written to the shared folder.
    Empty links give no rows; repeated links and links of a node to itself do no harm.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        ahead = labels.select(F.col("node").alias("via"), F.col("comp").alias("jump"))
        fresh = keep(spread.join(ahead, F.col("comp") == F.col("via"), "left").select("node", "old", F.least("comp", "jump").alias("comp")), "labels")
        labels = fresh.select("node", "comp")
        if fresh.filter("comp < old").isEmpty():
            return labels
