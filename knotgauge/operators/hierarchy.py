"""Names for the tree operators of units.py, and nesting of flat nodes at a JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .units import score_trees, unit_nodes

__all__ = ["nest", "nested_json", "score_trees", "unit_nodes"]


def nested_json(nodes: DataFrame) -> DataFrame:
    """(file_id, seq, level, branching, node_end) -> file_id, document: the same tree as nest() makes, as JSON text (k04).

    In the order of seq a node is followed by what is below it, so the text is written from left to
    right: each node opens its list of children and closes as many lists as the next node climbs.
    """
    after = F.coalesce(F.lead("level").over(Window.partitionBy("file_id").orderBy("seq")), F.lit(0))
    opened = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"level":'), F.col("level").cast("string"), F.lit(',"branching":'), F.col("branching").cast("string"), F.lit(',"node_end":'), F.col("node_end").cast("string"), F.lit(',"children":['))
    closed = F.when(after > F.col("level"), F.lit("")).when(after == 0, F.repeat(F.lit("]}"), (F.col("level") - 1).cast("int"))).otherwise(F.concat(F.repeat(F.lit("]}"), (F.col("level") - after + 1).cast("int")), F.lit(",")))
    parts = nodes.select("file_id", "seq", F.concat(opened, closed).alias("part"), (F.col("level") == 2).alias("top"))
    text = parts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part"))).alias("parts"), F.count_if("top").alias("tops"))
    return text.select("file_id", F.concat(F.lit('{"level":1,"branching":'), F.col("tops").cast("string"), F.lit(',"children":['), F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit("]}")).alias("document"))


def nest(nodes: list[dict]) -> dict:
    """Flat nodes of one file (seq, parent_seq, level, ...) as a recursive root; children in order (k04)."""
    root = {"level": 1, "children": []}
    known = {None: root}
    for node in sorted(nodes, key=lambda n: n["seq"]):
        own = {k: v for k, v in node.items() if k not in ("file_id", "parent_seq")} | {"children": []}
        known[node["seq"]] = own
        known[node["parent_seq"]]["children"].append(own)
    root["branching"] = len(root["children"])
    return root
